"""N-gram Jaccard join: documents linked by similar sets of word n-grams, found by PartEnum signatures.

Sets of sizes in one band, or two neighbouring ones, that are similar enough differ in at most k features.
The feature domain is cut into n1 parts, so that some part holds one difference at most, and each part
into three; two of these three then agree. A signature is the content of two of the three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.llm import blocks
from sentinel.llm.components import components
from sentinel.llm.words import Words, mix, slices, words_of
from sentinel.session import materialize

#: Bytes of a signature in a block, and of a feature in a set that is sent; collisions cost comparisons
#: only for signatures, and are below 10**-8 a pair of sets for features.
SIGNATURE_BYTES, FEATURE_BYTES = 5, 6
#: Features and sets of a part, about, of which a cell compares one or two; features of a part of sketches; members of
#: a signature's group that are looked at together; values of a block of a product.
CELL_FEATURES, CELL_SETS, CELL_SKETCHED, GROUP, BLOCK = 800_000, 2048, 6_000_000, 2048, 4_000_000
#: Bits of the sketch that is compared first, bits of a whole sketch for each feature at least, and bits at most.
SHORT, SPREAD, LONGEST = 1024, 4, 1 << 24
_FOUND = "bucket int, payload binary, doc bigint, n bigint, f1 bigint, f2 bigint, short binary, sketch binary"
_FOUND_NAMES = ["bucket", "payload", "doc", "n", "f1", "f2", "short", "sketch"]
_OUT = ("doc bigint, n bigint, f1 bigint, f2 bigint, short binary, sketch binary,"
        " met bigint, part int, parts int, members array<bigint>")


def features_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted within it, and offsets. A row of fewer words has one."""
    hashes, at = words.windows(width)
    row = words.row[at]
    cuts = np.searchsorted(row, np.arange(len(words.first)))
    counts = np.diff(words.first)
    sets, first = [], [0]
    for r in range(len(counts)):
        if counts[r] >= width:
            own = np.unique(hashes[cuts[r]: cuts[r + 1]])
        elif counts[r]:
            short = words.hashes[words.first[r]: words.first[r + 1]]
            value = np.uint64(counts[r])
            for h in short:
                value = mix(np.array([value ^ h]))[0]
            own = np.array([value], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        first.append(first[-1] + len(own))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(first)


def sketches(sets: np.ndarray, first: np.ndarray) -> tuple[list[bytes], list[bytes | None]]:
    """Short and whole sketch of each set: one bit a cell, whether the cell has an odd number of features.

    Cells are low bits of a hash, so folding a sketch's halves onto each other gives the sketch of half as many
    cells. Two sketches differ in at most as many bits as their sets have features that are not in both. A whole
    sketch that is the short one is left out.
    """
    sizes = np.diff(first)
    bits = np.minimum(np.maximum(SHORT, 1 << np.ceil(np.log2(np.maximum(SPREAD * sizes, 1))).astype(np.int64)), LONGEST)
    offset = np.concatenate([[0], np.cumsum(bits)])
    place = ((sets * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(36)).astype(np.int64)
    place = (place & (np.repeat(bits, sizes) - 1)) + np.repeat(offset[:-1], sizes)
    packed = np.packbits((np.bincount(place, minlength=offset[-1]) & 1).astype(np.uint8))
    if not len(sizes):
        return [], []
    short = np.bitwise_xor.reduceat(packed.reshape(-1, SHORT // 8), offset[:-1] // SHORT, axis=0)
    whole = [packed[offset[r] // 8: offset[r + 1] // 8].tobytes() if bits[r] > SHORT else None for r in range(len(sizes))]
    return [row.tobytes() for row in short], whole


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by key, modulo 2**64; halves add exactly as doubles."""
    low = np.bincount(keys, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(keys, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Upper sizes of the bands: within one, and into the next, sizes fit the similarity num / den."""
    out, low = [], 1
    while not out or out[-1] < largest:
        out.append(low * den // num)
        low = out[-1] + 1
    return np.array(out)


def signatures(sets: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the row of each. A set takes part in its band's instance and the next."""
    sizes = np.diff(first)
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tops = bands(int(sizes.max()), num, den)
    tops = np.append(tops, (tops[-1] + 1) * den // num)
    band = np.searchsorted(tops, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(sets ^ np.uint64(0xA0761D6478BD642F))
    out, rows = [], []
    for step in (0, 1):
        instance = band + step
        most = 2 * tops[instance] * (den - num) // (den + num)
        # a part more than needed, two for many: sets that have no empty cell pair in more parts can drop those
        n1 = np.where(most > 0, most // 2 + 1 + 1 + (most > 16), 1)
        n1[sizes == 0] = 0
        whole = np.flatnonzero((most == 0) & (sizes > 0))
        offset = np.concatenate([[0], np.cumsum(3 * n1)])
        parts = n1[owner].astype(np.uint64)
        part = ((sets >> np.uint64(32)) * parts) >> np.uint64(32)
        third = ((sets & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
        cell = offset[owner] + (part * np.uint64(3) + third).astype(np.int64)
        total = _sums(cell, spread, offset[-1]).reshape(-1, 3)
        filled = (np.bincount(cell, minlength=offset[-1]) > 0).reshape(-1, 3)
        of = np.repeat(np.arange(len(sizes)), n1)
        number = np.arange(len(of)) - (offset[:-1] // 3)[of]
        cut = most[of] > 0
        pairs = filled | np.roll(filled, -1, axis=1)
        spare = 1 + (most > 16)
        holes = np.bincount(of, ~pairs.all(axis=1), len(sizes))
        all_of = holes > spare
        for k in range(3):
            salt = mix((instance[of].astype(np.uint64) << np.uint64(34)) + (number.astype(np.uint64) << np.uint64(2)) + np.uint64(k))
            keep = cut & (pairs[:, k] | all_of[of])
            out.append(mix(total[keep, k] + total[keep, (k + 1) % 3] + salt[keep]))
            rows.append(of[keep])
        if len(whole):
            salt = mix((instance[whole].astype(np.uint64) << np.uint64(34)) + np.uint64(3))
            out.append(mix(total.sum(axis=1, dtype=np.uint64)[offset[whole] // 3] + salt))
            rows.append(whole)
    return np.concatenate(out), np.concatenate(rows)


def _entries(width: int, num: int, den: int, buckets: int):
    def flush(held: list[tuple], docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held:
            hashes, owner = (np.concatenate([h[i] for h in held]) for i in range(2))
            order = np.argsort(owner, kind="stable")
            rows = list(blocks.pack(hashes[order], owner[order], np.zeros(len(order), np.int64), [docs], buckets,
                                    SIGNATURE_BYTES))
            empty = [pa.nulls(len(rows), pa.int64())] * 4 + [pa.nulls(len(rows), pa.binary())] * 2
            yield pa.record_batch([*blocks.batch_of(rows).columns, *empty], names=_FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, seen, total = [], [], set(), 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                own = batch.column("doc")[lo:hi].to_numpy()
                sets, first = features_of(words_of(batch.column("text")[lo:hi], lower=True), width)
                sizes = np.diff(first)
                rows = np.repeat(np.arange(hi - lo), sizes)
                f1 = _sums(rows, mix(sets), hi - lo)
                f2 = _sums(rows, mix(~sets), hi - lo)
                n = hi - lo
                short, whole = sketches(sets, first)
                yield pa.record_batch(
                    [pa.array((own % buckets).astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(own), pa.array(sizes),
                     pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(short, pa.binary()), pa.array(whole, pa.binary())],
                    names=_FOUND_NAMES)
                # of equal sets in the task, the id met first stands for those after it
                fresh = np.zeros(n, bool)
                for r in np.argsort(own, kind="stable"):
                    key = (int(f1[r]), int(f2[r]))
                    if sizes[r] and (key not in seen):
                        seen.add(key)
                        fresh[r] = True
                chosen = np.flatnonzero(fresh)
                if len(chosen):
                    picked = np.concatenate([sets[first[r]: first[r + 1]] for r in chosen])
                    hashes, of = signatures(picked, np.concatenate([[0], np.cumsum(sizes[chosen])]), num, den)
                    held.append((hashes, of + sum(map(len, docs))))
                    docs.append(own[chosen])
                    total += len(hashes)
                if total >= blocks.FLUSH_ENTRIES:
                    yield from flush(held, np.concatenate(docs))
                    held, docs, seen, total = [], [], set(), 0
        if held:
            yield from flush(held, np.concatenate(docs))

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: the documents that share a signature, once for all signatures that the same ones share,
    large groups in parts; and the sets' own rows."""
    names = ["doc", "n", "f1", "f2", "short", "sketch"]
    sets = table.filter(table.column("payload").is_null()).select(names)
    empty = pa.schema([("met", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("members", pa.list_(pa.int64()))])
    for field in empty:
        sets = sets.append_column(field, pa.nulls(len(sets), field.type))
    payloads = table.column("payload").drop_null().to_pylist()
    if not payloads:
        return sets
    hashes, _, (docs,) = blocks.unpack(payloads, SIGNATURE_BYTES, 1)
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))
    hashes, docs = hashes[fresh], docs[fresh]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    sizes = np.diff(np.append(starts, len(docs)))
    marks = np.add.reduceat(mix(docs.view(np.uint64) + np.uint64(1)), starts)
    several = np.flatnonzero(sizes > 1)
    _, first = np.unique(marks[several], return_index=True)
    met, part, parts, members = [], [], [], []
    half = GROUP // 2
    for g in several[first]:
        own = docs[starts[g]: starts[g] + sizes[g]]
        pieces = [own] if len(own) <= GROUP else [own[i: i + half] for i in range(0, len(own), half)]
        met += [int(marks[g].view(np.int64))] * len(pieces)
        part += range(len(pieces))
        parts += [len(pieces)] * len(pieces)
        members += pieces
    n = len(met)
    cuts = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(members) if n else [], pa.int64()))
    found = pa.table([*[pa.nulls(n, sets.schema.field(c).type) for c in names], pa.array(met, pa.int64()),
                      pa.array(part, pa.int32()), pa.array(parts, pa.int32()), lists], names=sets.schema.names)
    return pa.concat_tables([sets, found.cast(sets.schema)])


def _spread(near: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
    """Of a symmetric relation: each document with the first of those it is connected to."""
    links, left = [], near.any(axis=1)
    for start in range(len(docs)):
        if not left[start]:
            continue
        left[start], front = False, np.array([start])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            links += [(int(docs[x]), int(docs[start])) for x in front]
    return links


def possible(docs: np.ndarray, sizes: np.ndarray, raw: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all pairs whose sketches allow the similarity: sets as similar as num / den differ in
    (den - num) / (den + num) of their sizes' sum at most, and sketches differ in no more bits than that."""
    least = min(map(len, raw))
    folded = [np.bitwise_xor.reduce(np.frombuffer(r, np.uint64).reshape(-1, least // 8), axis=0) for r in raw]
    words, near = np.array(folded), np.zeros((len(docs), len(docs)), bool)
    step = max(1, BLOCK // (len(docs) * words.shape[1]))
    for lo in range(0, len(docs), step):
        apart = np.bitwise_count(words[lo: lo + step, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
        near[lo: lo + step] = (den + num) * apart <= (den - num) * (sizes[lo: lo + step, None] + sizes[None, :])
    np.fill_diagonal(near, False)
    return _spread(near, docs)


def _by_key(keys: list[str], values: list[str], settle):
    """Rows sorted by key as (doc, peer) links: `settle` gets the rows of each key that has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select([*keys, *values])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not len(rows):
                continue
            of = np.array([rows.column(k).to_numpy() for k in keys])
            starts = np.flatnonzero(np.append(True, (of[:, 1:] != of[:, :-1]).any(axis=0)))
            # the last key may go on in the next batch
            yield _pairs(settled(rows, starts))
            held = rows.slice(starts[-1])
        if held is not None:
            yield _pairs(settled(held, np.array([0, len(held)])))

    def settled(rows: pa.Table, starts: np.ndarray) -> list[tuple[int, int]]:
        links = []
        for at in np.flatnonzero(np.diff(starts) > 1):
            own = rows.slice(starts[at], starts[at + 1] - starts[at])
            links += settle(list(zip(*(own.column(v).to_pylist() for v in values), strict=True)))
        return links

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())],
                           names=["doc", "peer"])


def _possible(num: int, den: int):
    def settle(held: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        # copies that other tasks met stand here under one name
        held = list(dict.fromkeys(held))
        if len(held) < 2:
            return []
        return possible(np.array([d for d, _, _ in held]), np.array([n for _, n, _ in held]), [b for _, _, b in held], num, den)

    return settle


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets, first = features_of(words_of(part.column("text"), lower=True), width)
                low = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES]).tobytes()
                cut = first * FEATURE_BYTES
                packed = pa.array([low[cut[r]: cut[r + 1]] for r in range(hi - lo)], pa.binary())
                yield pa.record_batch([part.column("cluster"), part.column("cells"), part.column("doc"), packed],
                                      names=["cluster", "cells", "doc", "features"])

    return run


def linked(docs: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Enough links to connect what similar pairs connect: each document with the first of its group.

    All pairs are compared, by a product of the sets' incidence matrix. Features that the same sets have
    are one weighted column, those of one set none.
    """
    sizes = np.array([len(s) for s in sets])
    if len(docs) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(docs[1]), int(docs[0]))] if den * shared >= num * (int(sizes.sum()) - shared) else []
    row = np.repeat(np.arange(len(docs)), sizes)
    _, feature = np.unique(np.concatenate(sets), return_inverse=True)
    width = int(feature.max()) + 1
    label = mix(np.arange(1, len(docs) + 1, dtype=np.uint64))
    member = _sums(feature, label[row], width)
    several = np.bincount(feature, minlength=width) > 1
    # a column for each distinct group of owners
    _, one, column, weight = np.unique(np.where(several, member, 0), return_index=True, return_inverse=True, return_counts=True)
    wide = len(one)
    keep = several[feature]
    pairs = np.unique(row[keep] * wide + column[feature[keep]])
    at_row, at_col = pairs // wide, pairs % wide
    order = np.argsort(at_col, kind="stable")
    at_row, at_col = at_row[order], at_col[order]
    near = np.zeros((len(docs), len(docs)), bool)
    # blocks of rows and of columns: a product and its operands stay small for any number of sets
    block = max(1, BLOCK // len(docs))
    step = max(1, min(4096, block))
    for top in range(0, len(docs), block):
        end = min(top + block, len(docs))
        shared = np.zeros((end - top, len(docs)), np.float32)
        for lo in range(0, wide, step):
            a, b = np.searchsorted(at_col, [lo, lo + step])
            if a == b:
                continue
            dense = np.zeros((len(docs), min(step, wide - lo)), np.float32)
            dense[at_row[a:b], at_col[a:b] - lo] = 1
            shared += (dense[top:end] * weight[lo: lo + step].astype(np.float32)) @ dense.T
        whole = shared.astype(np.int64)
        near[top:end] = den * whole >= num * (sizes[top:end, None] + sizes[None, :] - whole)
    np.fill_diagonal(near, False)
    return _spread(near, docs)


def _compare(num: int, den: int):
    def settle(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        sets = []
        for _, raw in held:
            wide = np.zeros((len(raw) // FEATURE_BYTES, 8), np.uint8)
            wide[:, :FEATURE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, FEATURE_BYTES)
            sets.append(wide.view(np.uint64).ravel())
        return linked(np.array([d for d, _ in held]), sets, num, den)

    return settle


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row: groups of documents whose n-gram sets
    are linked, directly or over others, by intersection >= num / den of the union.

    Words are compared with A-Z lower-cased. Fewer words than `width`: the whole sequence is the set's only
    feature. Null or empty text: an empty set, linked with nothing. Null id: component null. Rows of one id
    count as one document with the links of all of them.

    Equal sets fall together first, wherever they are. Sets that meet in a signature and whose short sketches don't
    rule the similarity out form clusters; in these the whole sketches are compared, a bit or two for each bit of
    similarity that is missing, and only sets that are still linked are sent and compared themselves. Clusters are
    compared in cells of bounded size, large ones by pairs of random parts. So every pair that shares a signature
    is judged and none is written out.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    buckets = 2 * blocks.bucket_count(own)
    found = own.where("doc is not null").mapInArrow(_entries(width, num, den, buckets), _FOUND)
    found = materialize(found.groupBy("bucket").applyInArrow(_meet, _OUT), "signatures")
    sets = found.where("met is null").select("doc", "n", "f1", "f2", "short", "sketch")
    first = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"))
    # each id by the first one of each of its sets, whichever of them a task met
    named = sets.select("doc", "n", "f1", "f2", "short").join(first, ["n", "f1", "f2"]).select("doc", "rep", "n", "short")
    copies = materialize(named.where("doc != rep").select("doc", F.col("rep").alias("peer")), "copies")

    met = found.where("met is not null").groupBy("met", "part", "parts", F.size("members")).agg(F.first("members").alias("members"))
    met = met.select("met", "part", "parts", F.explode("members").alias("doc")).join(named.hint("merge"), "doc")
    met = met.select("met", F.explode(_pairs_of(F.col("part").cast("bigint"), F.col("parts").cast("bigint"))).alias("pair"),
                     F.col("rep").alias("doc"), "n", "short")
    met = met.repartition("met", "pair").sortWithinPartitions("met", "pair", "doc")
    near = met.mapInArrow(_by_key(["met", "pair"], ["doc", "n", "short"], _possible(num, den)), "doc bigint, peer bigint")

    # sketches of a cluster first: what they leave are nearly the groups themselves
    members = _cells(components(near, "doc", "peer"), sets, num, den, CELL_SKETCHED)
    whole = sets.where("n > 0").select(F.col("doc").alias("of"), "n", F.coalesce("sketch", "short").alias("sketch"))
    shown = members.join(whole, F.col("doc") == F.col("of")).select("cluster", F.explode("cells").alias("cell"), "doc", "n", "sketch")
    shown = shown.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell")
    near = shown.mapInArrow(_by_key(["cluster", "cell"], ["doc", "n", "sketch"], _possible(num, den)), "doc bigint, peer bigint")
    members = materialize(_cells(components(near, "doc", "peer"), sets, num, den, CELL_FEATURES), "members")

    # texts meet a table with a row per document in a merge join at any size
    texts = own.where("text is not null").join(members.hint("merge"), "doc").select("cluster", "cells", "doc", "text")
    packed = texts.mapInArrow(_sets(width), "cluster bigint, cells array<bigint>, doc bigint, features binary")
    packed = packed.select("cluster", F.explode("cells").alias("cell"), "doc", "features")
    dealt = packed.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell")
    links = dealt.mapInArrow(_by_key(["cluster", "cell"], ["doc", "features"], _compare(num, den)), "doc bigint, peer bigint")
    groups = components(links.union(copies), "doc", "peer")
    out = sets.join(groups, sets.doc == groups.node, "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    blank = own.where("doc is null").mapInArrow(_counted(width), "doc bigint, n bigint")
    return out.union(blank.select("doc", "n", F.lit(None).cast("bigint")))


def _pairs_of(part: Column, parts: Column) -> Column:
    """Numbers of the pairs of parts that a part is in; a single part is the only pair."""
    zero = F.lit(0).cast("bigint")
    others = F.filter(F.sequence(zero, parts - 1), lambda x: x != part)
    return F.when(parts == 1, F.array(zero)).otherwise(
        F.transform(others, lambda x: F.least(x, part) * parts + F.greatest(x, part)))


def _cells(cluster: DataFrame, sets: DataFrame, num: int, den: int, features: int) -> DataFrame:
    """(doc, cluster, cells): the cells that compare a document, of about so many features. A cell holds the sizes of one band and the
    next smaller one, as similar sets differ by one band at most; where these are too many, a pair of parts."""
    log = lambda n: F.floor(F.log(n) / F.log(F.lit(1.01 * den / num)))
    known = sets.where("n > 0").groupBy("doc").agg(F.sum("n").alias("n"), log(F.min("n")).alias("low"), log(F.max("n")).alias("high"))
    members = cluster.join(known, cluster.node == F.col("doc")).select(
        "doc", F.col("component").alias("cluster"), "n", "high", F.explode(F.sequence(F.col("low"), F.col("high") + 1)).alias("band"))
    # a band without a set of its own would compare what the one below it does
    sizes = members.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.sum("n") / F.lit(features)), F.ceil(F.count("*") / F.lit(CELL_SETS))).alias("parts"), F.count("*").alias("all"), F.count_if(F.col("band") <= F.col("high")).alias("own"))
    sizes = sizes.where((F.col("all") > 1) & (F.col("own") > 0)).select("cluster", "band", "parts")
    pair = _pairs_of(F.pmod(F.xxhash64("doc"), F.col("parts")), F.col("parts"))
    band = F.col("band") * (1 << 50)
    placed = members.join(sizes, ["cluster", "band"]).select("doc", "cluster", F.transform(pair, lambda x: band + x).alias("cells"))
    return placed.groupBy("doc", "cluster").agg(F.flatten(F.collect_list("cells")).alias("cells"))


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                _, first = features_of(words_of(batch.column("text")[lo:hi], lower=True), width)
                yield pa.record_batch([batch.column("doc")[lo:hi], pa.array(np.diff(first))], names=["doc", "n"])

    return run


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that are the smallest of their group, one row of each; rows with a null id stay."""
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_llm_kept")).distinct()
    chosen = docs.join(kept.hint("merge"), F.col(id_col).cast("bigint") == F.col("_llm_kept"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(text_col)))
    return chosen.withColumn("_llm_nth", nth).where("_llm_nth = 1").drop("_llm_nth").union(docs.where(F.col(id_col).isNull()))
