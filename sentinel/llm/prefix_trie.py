"""Conversation prefix trie: double-array tries per shard of sorted paths, shared upper nodes merged globally.

A conversation becomes segments of at most SEGMENT turns, each a path below the node where it begins. Equal
segments collapse. Paths are range-partitioned in their own order and packed, shard by shard, into double
arrays: turn t of state s leads to BASE[s] + t if CHECK of that slot is s. Nodes whose subtree may reach into
another shard (those on a shard's first and last path, and above a segment that goes on) are *open*: their
parts are merged by key, and their subtrees are summed by pointer doubling. All other nodes are final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.session import materialize

#: Turns of a segment, turns of a shard about, length of the texts that ids are joined to before they are digested.
SEGMENT, SHARD_TURNS, ENDS_TEXT = 32, 100_000, 1 << 16
#: Bytes of a node's or turn's key, and of the depth at which a path begins.
KEY, DEPTH = 16, 8
#: Slots looked at for a family of children before it goes behind the last one, cells of that look.
NEAR, TRIES = 1024, 1_000_000
ROOT = bytes(KEY)
WORD = r"[^\x20\x09-\x0D]+"
_SEGMENT = "conv bigint, path binary, words binary, more boolean, ends binary"
_NODE = ("shard binary, node binary, parent binary, open boolean, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint,"
         " words bigint, n_children bigint, n_leaves bigint, saved bigint")


def _key(above: bytes, turn: bytes) -> bytes:
    """Key of the node that a turn leads to."""
    return hashlib.sha256(above + turn).digest()[:KEY]


class _Path:
    """The turns of one conversation, cut into segments; holds one segment at a time."""

    def __init__(self, conv: int, segment: int):
        self.conv, self.segment, self.depth, self.at, self.node = conv, segment, 0, ROOT, ROOT
        self.turns, self.words = [], []

    def add(self, turn: bytes, words: int) -> list[tuple]:
        done = [self._segment(True)] if len(self.turns) == self.segment else []
        if done:
            self.depth, self.at, self.turns, self.words = self.depth + self.segment, self.node, [], []
        self.node = _key(self.node, turn)
        self.turns.append(turn)
        self.words.append(words)
        return done

    def _segment(self, more: bool) -> tuple:
        path = self.depth.to_bytes(8, "big") + self.at + b"".join(self.turns)
        return self.conv, path, np.array(self.words, "<i8").tobytes(), more, None if more else self.node

    def end(self) -> tuple:
        return self._segment(False)


def _segments(most: int, segment: int):
    """Segments of conversations whose rows come in order, a donor before those that borrow its first turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donor, heads, path, nth = None, [], None, 0
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("donor", "conv", "head", "turn", "words")), strict=True)
            for of, conv, head, turn, words in rows:
                if path is None or conv != path.conv:
                    if path is not None:
                        out.append(path.end())
                    if of != donor:
                        donor, heads = of, []
                    path, nth = _Path(conv, segment), 0
                    if conv != of:
                        for lent in heads[:head]:
                            out += path.add(*lent)
                if conv == of:
                    if nth < most:
                        heads.append((turn, words))
                    out += path.add(turn, words)
                elif nth >= head:
                    out += path.add(turn, words)
                nth += 1
            yield _segment_batch(out)
        if path is not None:
            yield _segment_batch([path.end()])

    return run


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                           names=["conv", "path", "words", "more", "ends"])


class DoubleArray:
    """A trie over rows of dense ids (1 and up, 0 behind a row's end), rows sorted by their ids' values.

    `levels` holds, for each level, the rows that bring a new node there. Children that are alone fill the
    slots that wider families leave free.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        rows, depth = codes.shape
        valid = np.arange(depth) < sizes[:, None]
        same = np.zeros((rows, depth), bool)
        same[1:] = np.logical_and.accumulate((codes[1:] == codes[:-1]) & valid[1:] & valid[:-1], axis=1)
        new = valid & ~same
        self.levels = [np.flatnonzero(new[:, level]) for level in range(depth)]
        room = int(new.sum()) + int(codes.max(initial=0)) + 2
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0], self._low, self._end = 0, 1, 1
        at = np.zeros(rows, np.int64)
        for level, fresh in enumerate(self.levels):
            if len(fresh):
                self._place(at[fresh], codes[fresh, level])
            live = np.flatnonzero(valid[:, level])
            at[live] = self.step(at[live], codes[live, level])

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the ids lead; a missing edge is an error, as only packed rows are walked."""
        to = self.base[states] + ids
        if (self.check[to] != states).any():
            raise LookupError("no such path")
        return to

    def _room(self, end: int) -> None:
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        free = self._low + np.flatnonzero(self.check[self._low:] < 0)
        if len(free) < n:
            short = n - len(free)
            free = np.append(free, np.arange(len(self.check), len(self.check) + short))
            self._room(len(self.check) + short)
        return free[:n]

    def _place(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Slots for the children of one level, wide families first."""
        order = np.lexsort((ids, parents))
        parents, ids = parents[order], ids[order]
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(starts, len(parents)))
        for f in np.argsort(-counts, kind="stable"):
            if counts[f] == 1:
                break
            family = ids[starts[f]: starts[f] + counts[f]]
            self._settle(parents[starts[f]], family, self._fit(family - family[0]))
        alone = starts[counts == 1]
        slots = self._free(len(alone))
        self.base[parents[alone]] = slots - ids[alone]
        self.check[slots] = parents[alone]
        self._end = max(self._end, int(slots.max(initial=0)) + 1)

    def _fit(self, apart: np.ndarray) -> int:
        """A slot for the first of some children, so that all of them find theirs free: one of the first free ones,
        or behind the last slot in use."""
        while self._low < len(self.check) and self.check[self._low] >= 0:
            self._low += 1
        free = self._low + np.flatnonzero(self.check[self._low: self._low + NEAR] < 0)[:max(1, TRIES // len(apart))]
        self._room(max(self._low + NEAR, self._end) + int(apart[-1]) + 1)
        fits = np.flatnonzero((self.check[free[:, None] + apart] < 0).all(axis=1))
        return int(free[fits[0]]) if len(fits) else self._end

    def _settle(self, parent: int, family: np.ndarray, slot: int) -> None:
        self.base[parent] = slot - family[0]
        self.check[slot + family - family[0]] = parent
        self._end = max(self._end, slot + int(family[-1] - family[0]) + 1)


def _dense(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Ids by first appearance, level by level, so that siblings' ids lie close."""
    codes = np.zeros(values.shape, np.int64)
    flat = values.T[valid.T]
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    codes.T[valid.T] = rank[inverse]
    return codes


def shard_nodes(paths: list[bytes], words: list[bytes], counts: np.ndarray, convs: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Nodes of distinct sorted paths; level 0 is the node below which a segment hangs."""
    rows, sizes = len(paths), np.array([(len(p) - DEPTH) // KEY for p in paths])
    depth = int(sizes.max())
    values = np.zeros((rows, depth), f"V{KEY}")
    valid = np.arange(depth) < sizes[:, None]
    values[valid] = np.frombuffer(b"".join(p[DEPTH:] for p in paths), f"V{KEY}")
    spent = np.zeros((rows, depth), np.int64)
    spent[:, 1:][valid[:, 1:]] = np.frombuffer(b"".join(words), "<i8")
    codes = _dense(values, valid)
    trie = DoubleArray(codes, sizes)

    room = len(trie.check)
    n, kids, leaves, saved, deep, word = (np.zeros(room, np.int64) for _ in range(6))
    least, opened = np.full(room, np.iinfo(np.int64).max), np.zeros(room, bool)
    goes_on = more.copy()
    goes_on[[0, -1]] = True
    inner = np.array([p[:DEPTH] != bytes(DEPTH) for p in paths])  # its upper node is counted where the segment above ends
    keys: list[bytes] = [b""] * room
    at, levels = np.zeros(rows, np.int64), []
    for level, fresh in enumerate(trie.levels):
        live = np.flatnonzero(valid[:, level])
        at[live] = trie.step(at[live], codes[live, level])
        counted = live[~inner[live]] if level == 0 else live
        np.add.at(n, at[counted], counts[counted])
        np.minimum.at(least, at[counted], convs[counted])
        opened[at[live] if level == 0 else at[live[goes_on[live]]]] = True
        own = at[fresh]
        levels.append(own)
        word[own] = spent[fresh, level]
        deep[own] = [int.from_bytes(paths[r][:DEPTH], "big") + level for r in fresh]
        for state, row in zip(own.tolist(), fresh.tolist(), strict=True):
            turn = paths[row][DEPTH + level * KEY: DEPTH + (level + 1) * KEY]
            keys[state] = turn if level == 0 else _key(keys[trie.check[state]], turn)
    for own in reversed(levels[1:]):
        final = own[~opened[own]]
        leaves[final[kids[final] == 0]] = 1
        saved[final] += (n[final] - 1) * word[final]
        above = trie.check[final]
        np.add.at(kids, above, 1)
        np.add.at(leaves, above, leaves[final])
        np.add.at(saved, above, saved[final])

    top = len(levels[0])
    own = np.concatenate(levels)
    above = trie.check[own]
    inside = np.arange(len(own)) < top
    link = ~inside & opened[above]  # the parent's key is known here, its smallest member is not
    known = least[own] < np.iinfo(np.int64).max
    shard = hashlib.sha256(paths[0]).digest()[:KEY]
    return pa.record_batch([
        pa.array([shard] * len(own), pa.binary()), pa.array([keys[s] for s in own], pa.binary()),
        pa.array([keys[s] if k else None for s, k in zip(above, link, strict=True)], pa.binary()), pa.array(opened[own]), pa.array(deep[own]),
        pa.array(least[own], mask=~known), pa.array(least[above], mask=inside | link), *[pa.array(x[own]) for x in (n, word, kids, leaves, saved)],
    ], names=[f.split()[0] for f in _NODE.split(", ")])


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "conv", "more")), strict=True):
                held.append(row)
                turns += len(row[0]) // KEY
                if turns >= most:
                    yield _shard(held)
                    held, turns = [], 0
        if held:
            yield _shard(held)

    return run


def _shard(held: list[tuple]) -> pa.RecordBatch:
    paths, words, n, convs, more = zip(*held, strict=True)
    return shard_nodes(list(paths), list(words), np.array(n), np.array(convs), np.array(more))


def _subtrees(upper: DataFrame) -> DataFrame:
    """(node, n_leaves, saved) of whole subtrees of a tree with parents and own values, by pointer doubling.

    After k rounds a node has the sum of its descendants less than 2**k levels below, and points 2**k up.
    """
    state = upper.select("node", F.col("parent").alias("jump"), "n_leaves", "saved")
    deepest, reach = upper.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        below = state.where("jump is not null").groupBy(F.col("jump").alias("of")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = state.where("jump is not null").select(F.col("node").alias("via"), F.col("jump").alias("next"))
        state = state.join(below, state.node == below.of, "left").join(up, F.col("jump") == up.via, "left").select(
            "node", F.col("next").alias("jump"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        state, reach = materialize(state, "subtrees"), 2 * reach
    return state.select("node", "n_leaves", "saved")


def prefix_trie(turns: DataFrame, donor: str = "conv_id", head: str = "0", most: int = 0,
                segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of all conversations, and (node, conv_id) of where each conversation ends.

    `turns` has conv_id, turn, role, text. Nodes have node and parent keys (null for the root), depth, conv_id
    (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. `donor` and `head` are SQL over
    conv_id: a conversation begins with the first `head` (at most `most`) turns of its donor and goes on with its
    own turns after its first `head`; a donor stays as it is. All conversations of a donor stand in one task in
    order, none of them is held whole.

    Turns are ordered by number, nulls first; turns of one number by the digest of (role, text), so repeated rows
    are turns like others. Null role or text: empty. Null conv_id: no conversation. Conversations that end up
    without turns are members of the root. An empty table has no nodes. Turns are told apart by 128 bits of
    SHA-256. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.expr(donor).cast("bigint").alias("donor"), conv.alias("conv"), F.expr(head).cast("int").alias("head"), F.col("turn").alias("nth"),
        F.unhex(F.substring(digest, 1, 2 * KEY)).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    rows = rows.repartition("donor").sortWithinPartitions("donor", F.col("conv") != F.col("donor"), "conv", F.col("nth").asc_nulls_first(), "turn")
    segments = materialize(rows.mapInArrow(_segments(most, segment), _SEGMENT), "segments")

    paths = segments.groupBy("path", "words").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("more").alias("more"))
    # shards are heavy for their bytes: a number given here isn't merged for their size
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(paths, "paths").repartitionByRange(tasks, "path").sortWithinPartitions("path")
    found = materialize(dealt.mapInArrow(_shards(shard_turns), _NODE), "nodes")

    parts = found.where("open")
    merged = parts.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
    merged = materialize(merged, "merged")
    open_kids = merged.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("open_kids"))
    kids = F.col("n_children") + F.coalesce("open_kids", F.lit(0))
    upper = merged.join(open_kids, merged.node == open_kids.of, "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", kids.alias("n_children"),
        (F.col("n_leaves") + F.when(kids == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    upper = materialize(upper, "upper")
    above = upper.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    whole = _subtrees(upper).withColumnRenamed("node", "same")
    names = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    tops = upper.drop("n_leaves", "saved").join(whole, F.col("node") == F.col("same")).join(above, F.col("parent") == above.of, "left").select(names)

    final = found.where("not open")
    # an open node's name travels by (shard, node), as very many children may hang below one; where a segment ends and
    # the next begins in the same shard, the node is there twice
    named = parts.select("shard", F.col("node").alias("of")).distinct().join(above.select(F.col("of").alias("key"), F.col("parent_conv_id").alias("up")),
                                                                    F.col("of") == F.col("key")).select(F.col("shard").alias("in"), "of", "up")
    hanging = final.where("parent is not null").join(named, (F.col("shard") == F.col("in")) & (F.col("parent") == F.col("of")))
    hanging = hanging.drop("parent_conv_id").withColumnRenamed("up", "parent_conv_id").select(names)
    nodes = final.where("parent is null").select(names).union(hanging).union(tops).withColumnRenamed("saved", "saved_tokens")
    return nodes, segments.where("ends is not null").select(F.col("ends").alias("node"), F.col("conv").alias("conv_id"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, those of one node in texts of bounded length: (node, first, text)."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != node or size >= ENDS_TEXT:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids, size = key, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield _rows(out, ("node", "first", "text"), (pa.binary(), pa.int64(), pa.string()))
    if ids:
        yield _rows([(node, first, ",".join(ids))], ("node", "first", "text"), (pa.binary(), pa.int64(), pa.string()))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's texts, read one after the other."""
    node, state = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(text.encode())
        yield _rows(out, ("node", "ends_sha256"), (pa.binary(), pa.string()))
    if state is not None:
        yield _rows([(node, state.hexdigest())], ("node", "ends_sha256"), (pa.binary(), pa.string()))


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end at a node, ascending and comma-joined.

    Ids are ordered by range, so those of a hot node are joined in many tasks; their texts then stream through one.
    """
    texts = ends.orderBy("node", "conv_id").mapInArrow(_joined, "node binary, first bigint, text string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node binary, ends_sha256 string")
