"""Source divergence audit: how the words of a language's sources differ, from count-level bitmaps.

All terms with count i in a group form a bitset over term ids. The terms with count i in one group and j in
another are the bits that two bitsets share, so a divergence is a sum over such cells of their size times one
value; terms without occurrences follow by complement. Ids are dense within a part of a language's terms, and
bitsets are words of 64 bits, worked on for all groups of the language together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinel.llm.words import slices
from sentinel.session import materialize

#: Share of one: probabilities are whole numbers of this.
UNIT = 1_000_000_000
#: Terms that a task counts before it sends them, rows of a part of a language's terms about, cells worked on at once.
HELD, PART_ROWS, CELLS = 400_000, 100_000, 4_000_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_FOUND = "lang string, source string, part string, item string, value bigint"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts one after the other, A-Z lower-cased, and the row of each.

    A term is a run of ASCII letters and characters beyond ASCII; these have no byte below 128.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    begin, end = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if begin == end:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    raw, offsets = np.frombuffer(data, np.uint8, end - begin, begin), offsets - begin
    inside = _LETTER[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    letters = _LOWER[raw[inside]]
    cuts = np.append((np.cumsum(inside) - 1)[starts], len(letters)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents, of each term in each group, added up within a task."""
    held, rows = [], 0

    def sums(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return out.rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            terms, row = terms_of(part.column("text"))
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            kinds = len(coded.dictionary)
            each, times = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
            row, term = each // kinds, coded.dictionary.take(pa.array(each % kinds))
            at = pa.array(row)
            held.append(sums([pa.table([part.column("lang").take(at), part.column("source").take(at), term, pa.array(times),
                                        pa.array(np.ones(len(times), np.int64))], names=["lang", "source", "term", "n", "docs"])]))
            rows += len(held[-1])
            if rows >= HELD:
                whole = sums(held)
                held, rows = [whole], len(whole)
                if 2 * rows >= HELD:  # little to gain from waiting
                    yield from whole.combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from sums(held).combine_chunks().to_batches()


def _shares(counts: np.ndarray, all_of: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (sum + terms)); wide integers where 64 bits don't hold the product."""
    if len(counts) and int(counts.max()) >= (2**63 - 1) // UNIT - 1:
        wide = [1 + UNIT * (int(c) + 1) // (int(a) + int(t)) for c, a, t in zip(counts, all_of, terms, strict=True)]
        return np.array(wide, np.int64)
    return 1 + UNIT * (counts + 1) // (all_of + terms)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def cells(term: np.ndarray, group: np.ndarray, count: np.ndarray, terms: int, groups: int, share: np.ndarray, none: np.ndarray) -> np.ndarray:
    """[groups, groups] sums, over `terms` dense ids, of f(share in the first group, share in the second).

    Entries (term, group, count > 0) have `share`; a group's share of a term it lacks is `none`.
    """
    total = np.zeros((groups, groups), np.int64)
    block = term >> 6
    order = np.lexsort((count, group, block))
    term, group, count, share, block = (x[order] for x in (term, group, count, share, block))
    new = np.ones(len(term), bool)
    new[1:] = (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (count[1:] != count[:-1])
    starts = np.flatnonzero(new)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (term & 63).astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
    owner, level, of = group[starts], share[starts], block[starts]
    cuts = np.searchsorted(of, np.arange((terms + 63) // 64 + 1))
    both_none = _apart(none[:, None], none[None, :])
    for b in range(len(cuts) - 1):
        size = min(64, terms - 64 * b)
        lo, hi = cuts[b], cuts[b + 1]
        mask, who, p = bits[lo:hi], owner[lo:hi], level[lo:hi]
        if lo == hi:
            total += size * both_none
            continue
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        there = who[first]
        any_of = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)
        absent = np.full(groups, size, np.int64)
        absent[there] -= any_of
        # terms that neither has: all, less those of the one or the other
        neither = absent[:, None] + absent[None, :] - size
        step = max(1, CELLS // len(mask))
        edges, top = np.append(first, len(mask)), 0
        while top < len(there):
            end = max(top + 1, int(np.searchsorted(edges, edges[top] + step, side="right")) - 1)
            at = slice(edges[top], edges[end])
            joint = np.bitwise_count(mask[at, None] & mask[None, :]).astype(np.int64)
            inner = first[top:end] - edges[top]
            met = np.add.reduceat(joint, first, axis=1)  # of a level's terms, those that a group has
            both = np.add.reduceat(met, inner, axis=0)
            rows = there[top:end]
            total[np.ix_(rows, there)] += np.add.reduceat(np.add.reduceat(joint * _apart(p[at, None], p[None, :]), first, axis=1), inner, axis=0)
            neither[np.ix_(rows, there)] += both
            # a level's terms that another group lacks, by complement: against groups that are there, and all others
            own = np.bitwise_count(mask[at]).astype(np.int64)
            lacks = np.repeat(own[:, None], groups, axis=1)
            lacks[:, there] -= met
            total[rows] += np.add.reduceat(lacks * _apart(p[at, None], none[None, :]), inner, axis=0)
            total[:, rows] += np.add.reduceat(lacks * _apart(none[None, :], p[at, None]), inner, axis=0).T
            top = end
        total += neither * both_none
    return total


def _part(top: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one part of a language's terms: every pair's sum, and the best terms of every group.

        Rows without a term are the groups: n their sum over kept terms, total the language's, kept its terms.
        """
        heads = table.filter(table.column("term").is_null())
        names = heads.column("source").combine_chunks()
        rows = table.filter(table.column("term").is_valid())
        sums, langs, kept = (heads.column(c).to_numpy().astype(np.int64) for c in ("n", "total", "kept"))
        groups, lang = len(names), heads.column("lang")[0]
        n, whole = rows.column("n").to_numpy().astype(np.int64), rows.column("total").to_numpy().astype(np.int64)
        coded = rows.column("term").combine_chunks().dictionary_encode()
        kinds, term = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = pa.compute.index_in(rows.column("source").combine_chunks(), names)
        group = place.to_numpy(zero_copy_only=False).astype(np.int64)
        of = lambda count, everything: _shares(count, everything, np.full(len(count), kept[0]))
        p = of(n, sums[group])
        # frequent terms first: the words of 64 terms then have few levels but for the first ones
        weight = np.zeros(kinds, np.int64)
        weight[term] = whole
        dense = np.empty(kinds, np.int64)
        dense[np.argsort(-weight, kind="stable")] = np.arange(kinds)
        none = of(np.zeros(groups, np.int64), sums) if kept[0] else np.ones(groups, np.int64)
        total = cells(dense[term], group, n, kinds, groups, p, none)
        at, other = np.nonzero(~np.eye(groups, dtype=bool))
        pairs = [pa.array(at), pa.array(other), pa.array(total[at, other])]

        q = of(whole, np.full(len(n), langs[0]))
        best = np.flatnonzero(p > q)
        value = _apart(p[best], q[best])
        text = rows.column("term").combine_chunks().take(pa.array(best))
        ranked = pa.table([pa.array(group[best]), pa.array(value), text.cast(pa.binary()), pa.array(best)], names=["group", "value", "text", "at"])
        ranked = ranked.sort_by([("group", "ascending"), ("value", "descending"), ("text", "ascending")])
        own = ranked.column("group").to_numpy()
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        chosen = ranked.filter(pa.array(nth < top))
        size = len(at) + len(chosen)
        return pa.table([
            pa.array([lang.as_py()] * size, pa.string()),
            pa.chunked_array([names.take(pairs[0]), names.take(chosen.column("group").combine_chunks())]).combine_chunks(),
            pa.array(["pair"] * len(at) + ["term"] * len(chosen), pa.string()),
            pa.chunked_array([names.take(pairs[1]), rows.column("term").combine_chunks().take(chosen.column("at").combine_chunks())]).combine_chunks(),
            pa.chunked_array([pairs[2], chosen.column("value").combine_chunks()]).combine_chunks(),
        ], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language and the divergence
    from it, part `term` the `top` terms that most set a source apart from its language.

    Terms are kept if `least_docs` documents of the language have them. A group's share of a term is
    p = 1 + floor(10**9 * (count + 1) / (N + V)); a value is floor((p - q)**2 / q), summed over terms for pairs,
    q being the other's share. Arithmetic is exact.

    Null text, language or source: empty ones. A text without terms still makes its group. A language without kept
    terms: pairs of value 0, no terms. A single source: no pairs. Repeated rows are documents like others. Ties: items
    in UTF-8 order. An empty table gives no rows; other columns are not read. Sources of a language meet in one
    task as one count a term and a sum a pair; their pairs are the result.
    """
    empty = F.lit("")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = own.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term),
                                   "nth": F.row_number().over(of_term.orderBy("source"))})
    kept = materialize(counted.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("nth") == 1).alias("once")), "terms")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if("once").alias("kept"), F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    heads = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", zero).alias("n"), F.coalesce("total", zero).alias("total"),
        F.coalesce("kept", zero).alias("kept"), F.explode(F.sequence(zero, F.coalesce("parts", F.lit(1).cast("bigint")) - 1)).alias("at"))
    rows = kept.join(langs.select("lang", "parts"), "lang").select(
        "lang", "source", "term", "n", "total", zero.alias("kept"), F.pmod(F.xxhash64("term"), F.col("parts")).alias("at"))
    found = rows.union(heads).groupBy("lang", "at").applyInArrow(_part(top), _FOUND)
    # a part has each group's best terms, and a pair's sum over its terms
    found = materialize(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "values")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs, terms = (found.where(F.col("part") == name).withColumn("rank", rank) for name in ("pair", "term"))
    return pairs.union(terms.where(F.col("rank") <= top))
