"""Substring dedup: words covered by a window that an earlier document also has are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sentinel.llm import blocks
from sentinel.llm.words import mix, slices, words_of

#: Words of a window.
WIDTH = 13
#: Bytes of a window hash in a block; the bucket adds the high bits.
HASH_BYTES = 7
_FOUND = "bucket int, payload binary, part int"
_FOUND_NAMES = ["bucket", "payload", "part"]
_PLACES = "doc bigint, mark bigint, places array<int>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mark(text: str | Column) -> Column:
    """Tells rows with the same id and other texts apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def _settled(docs: np.ndarray, marks: np.ndarray, places: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, block) of places that are to go; a part gathers all of a document."""
    order = np.lexsort((places, marks, docs))
    docs, marks, places = docs[order], marks[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    spread = mix(docs.view(np.uint64))
    return list(blocks.pack(spread, np.cumsum(new) - 1, places, [docs[first], marks[first]], parts, 0))


def _later(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of entries: whether a smaller document has the same hash."""
    order = np.argsort(hashes, kind="stable")
    ranked, owners = hashes[order], docs[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    least = np.minimum.reduceat(owners, starts)
    out = np.empty(len(hashes), bool)
    out[order] = owners > np.repeat(least, np.diff(np.append(starts, len(ranked))))
    return out


def _entries(width: int, buckets: int):
    """Windows of many documents as blocks. Those that repeat within the task are settled at once and only
    the smallest document's go on, so a passage of very many documents reaches its bucket once a task."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, owner, places = (np.concatenate([h[i] for h in held]) for i in range(3))
        docs, marks = (np.concatenate([h[i] for h in held]) for i in (3, 4))
        if not len(hashes):
            return
        later = _later(hashes, docs[owner])
        if later.any():
            sent = blocks.batch_of(_settled(docs[owner[later]], marks[owner[later]], places[later], buckets))
            yield pa.record_batch([*sent.columns, sent.column(0)], names=_FOUND_NAMES)
        first = ~later
        rows = list(blocks.pack(hashes[first], owner[first], places[first], [docs, marks], buckets, HASH_BYTES))
        yield pa.record_batch([*blocks.batch_of(rows).columns, pa.nulls(len(rows), pa.int32())], names=_FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, rows = [], 0, 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words = words_of(part.column("text"))
                hashes, at = words.windows(width)
                row = words.row[at]
                held.append((hashes, row + rows, at - words.first[row], part.column("doc").to_numpy(),
                             part.column("mark").to_numpy()))
                rows, total = rows + hi - lo, total + len(hashes)
                if total >= blocks.FLUSH_ENTRIES:
                    yield from flush(held)
                    held, total, rows = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _judge(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: places whose window a smaller document has, and those that tasks settled before."""
        open_ = table.column("part").is_null()
        known = table.filter(table.column("part").is_valid()).select(["part", "payload"])
        payloads = table.filter(open_).column("payload").to_pylist()
        if not payloads:
            return known
        hashes, places, (docs, marks) = blocks.unpack(payloads, HASH_BYTES, 2)
        later = _later(hashes, docs)
        rows = _settled(docs[later], marks[later], places[later], buckets)
        found = pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
                         names=["part", "payload"])
        return pa.concat_tables([known.cast(found.schema), found])

    return run


def _gather(table: pa.Table) -> pa.Table:
    """Of one part: a row for each document with all its places."""
    _, places, (docs, marks) = blocks.unpack(table.column("payload").to_pylist(), 0, 2)
    order = np.lexsort((places, marks, docs))
    docs, marks, places = docs[order], marks[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)), pa.int32()), pa.array(places, pa.int32()))
    return pa.table([pa.array(docs[first], pa.int64()), pa.array(marks[first], pa.int64()), lists], names=["doc", "mark", "places"])


def repeated_places(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, places): per document, where windows start that also start in a smaller document."""
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    buckets = 2 * blocks.bucket_count(own)
    found = own.mapInArrow(_entries(width, buckets), _FOUND)
    judged = found.groupBy("bucket").applyInArrow(_judge(buckets), "part int, payload binary")
    return judged.groupBy("part").applyInArrow(_gather, _PLACES)


def _kept(width: int, text_col: str):
    def one(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        if not places:
            return text, len(text.encode().split()), 0
        raw = text.encode()
        starts = [m.start() for m in _WORD.finditer(raw)]
        edge = np.zeros(len(starts) + 1, np.int64)
        at = np.unique(np.asarray(places))
        edge[at] += 1
        edge[at + width] -= 1
        # overlapping windows merge: a word stays where no window is open
        stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        ends = [*starts[1:], len(raw)]
        kept = raw[: starts[0]] + b"".join([raw[starts[i]: ends[i]] for i in stays])
        return kept.decode(), len(starts), len(starts) - len(stays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column(text_col), batch.column("_llm_places")
            for lo, hi in slices(texts):
                part = batch.slice(lo, hi - lo)
                rows = [one(t.as_py(), p.as_py()) for t, p in zip(texts[lo:hi], places[lo:hi], strict=True)]
                columns = {n: part.column(n) for n in part.schema.names if n != "_llm_places"}
                columns[text_col] = pa.array([r[0] for r in rows], pa.string())
                columns["n_words"] = pa.array([r[1] for r in rows], pa.int64())
                columns["n_removed"] = pa.array([r[2] for r in rows], pa.int64())
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without repeated passages, and `n_words` and `n_removed` of each.

    A word goes if a window of `width` words covers it whose sequence also starts in a document with a
    smaller id; windows are judged on the input. A word goes with the white space after it; all else stays as it
    is, and so does a text without such words. Windows are compared by hashes modulo 2**61 - 1: two different ones
    are taken for equal with a chance of about `width` in 2**61, for one window about that times the corpus' windows.

    Null text: stays null, no words. Empty text: no words. Fewer words than a window: kept. Null id: neither
    removed nor removing. Repeated rows, and rows of one id with other texts, don't remove each other's
    words. Result columns replace columns of the same name; other columns pass.
    """
    places = repeated_places(docs, width, id_col, text_col).hint("merge")
    base = docs.drop("n_words", "n_removed")
    keyed = base.withColumn("_llm_doc", F.col(id_col).cast("bigint")).withColumn("_llm_mark", _mark(text_col))
    joined = keyed.join(places, (F.col("_llm_doc") == places.doc) & (F.col("_llm_mark") == places.mark), "left")
    shaped = joined.select(*[keyed[c] for c in base.columns], places.places.alias("_llm_places"))
    schema = StructType([*base.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return shaped.mapInArrow(_kept(width, text_col), schema)
