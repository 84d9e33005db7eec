"""Exact top-k search by inner product: no-random-access aggregation over sorted component lists.

A query's score for a candidate is a sum over dimensions. For each dimension the candidates of a block are
sorted by component: from the top for queries whose component is positive, from the bottom for negative
ones. Lists are read in rounds to growing depths. After a round a candidate's upper bound is what was read
of it plus, for each list where it has not come up, the value at which the reading stands; its lower bound
takes the worst value of those lists. The candidates that look best after the first round are resolved at once,
so that the k-th known score is a high floor. A candidate whose upper bound is below the floor is out, a query
without others is done; when the lists end, what is left is scored in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinel.llm.vectors import finite
from sentinel.session import materialize

#: Candidates whose lists are read together, queries worked on together, candidates of a cell at most and at least, queries of a cell.
BLOCK, TOGETHER, CELL, SMALL_CELL, QUERIES = 2048, 256, 16384, 1024, 8192
#: Depths of the rounds, as shares of a list.
DEPTHS = (0.25, 0.5, 0.75)
#: Candidates of a block that are resolved first, times k.
FIRST = 4


def _exact(most: float, width: int) -> type:
    """Doubles where every sum of products is an integer they hold, else 64-bit integers."""
    return np.float64 if most * most * width < 2**53 else np.int64


def _kth(scores: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th best of the ids' best scores; columns of an id lie together, from `starts` on."""
    each = scores if len(starts) == scores.shape[1] else np.maximum.reduceat(scores, starts, axis=1)
    n = each.shape[1]
    if n < k:
        return np.full(len(scores), _least(scores.dtype), scores.dtype)
    return np.partition(each, n - k, axis=1)[:, n - k]


def _least(kind) -> float | int:
    return -np.inf if kind == np.float64 else np.iinfo(np.int64).min


def lists(ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's sorted lists: place of each component in its list, the lists, and where each id's rows begin."""
    order = np.argsort(block, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(block))[:, None], axis=0)
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return rank, np.take_along_axis(block, order, axis=0), starts


def rounds(ids: np.ndarray, block: np.ndarray, sorted_lists: tuple, query_ids: np.ndarray, queries: np.ndarray,
           floor: np.ndarray, k: int) -> np.ndarray:
    """Which (query, candidate) pairs can still be among the k best, `floor` being known k-th best scores.

    `ids` are sorted; a query's own rows are never among them, and an id counts once. Bounds of all pairs are a
    product of what was read and the queries' positive and negative parts.
    """
    n, least = len(block), _least(block.dtype)
    rank, ranked, starts = sorted_lists
    alive = query_ids[:, None] != ids
    floor, todo = floor.copy(), np.arange(len(queries))
    for nth, depth in enumerate(DEPTHS):
        read = int(n * depth)
        if read == 0:
            continue
        up, down = np.maximum(queries[todo], 0), np.minimum(queries[todo], 0)
        top, bottom = rank >= n - read, rank < read
        at_top, at_bottom = ranked[n - read], ranked[read - 1]  # where the reading stands
        upper = up @ np.where(top, block, at_top).T + down @ np.where(bottom, block, at_bottom).T
        lower = up @ np.where(top, block, ranked[0]).T + down @ np.where(bottom, block, ranked[-1]).T
        lower[~alive[todo]] = least
        floor[todo] = np.maximum(floor[todo], _kth(lower, starts, k))
        if nth == 0:
            # those in the middle of high bounds are resolved: a floor that few others reach
            hope = np.where(alive[todo], upper + lower, least)
            some = min(n, FIRST * k)
            picked = np.argpartition(hope, n - some, axis=1)[:, n - some:]
            scores = np.full(hope.shape, least, block.dtype)
            known = np.einsum("qcd,qd->qc", block[picked], queries[todo])
            np.put_along_axis(scores, picked, np.where(np.take_along_axis(alive[todo], picked, axis=1), known, least), axis=1)
            floor[todo] = np.maximum(floor[todo], _kth(scores, starts, k))
        alive[todo] &= upper >= floor[todo, None]
        todo = todo[alive[todo].sum(axis=1) > k]
        if not len(todo):
            break
    return alive


def best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) rows: for each query its k best other ids, ties to smaller ones.

    Rows of one id count once, with the best score.
    """
    kind = _exact(float(max(np.abs(vectors).max(), np.abs(queries).max())), vectors.shape[1])
    order = np.argsort(ids, kind="stable")
    ids, vectors, asked = ids[order], vectors[order], queries.astype(kind)
    floor = np.full(len(queries), _least(np.dtype(kind)), kind)
    parts = [slice(lo, lo + TOGETHER) for lo in range(0, len(queries), TOGETHER)]
    found = [[np.zeros(0, np.int64)] * 3 for _ in parts]
    for lo in range(0, len(ids), BLOCK):
        own, block = ids[lo: lo + BLOCK], vectors[lo: lo + BLOCK].astype(kind)
        sorted_lists = lists(own, block)
        for at, part in enumerate(parts):
            query, row = np.nonzero(rounds(own, block, sorted_lists, query_ids[part], asked[part], floor[part], k))
            scores = np.einsum("ij,ij->i", block[row], asked[part][query]).astype(np.int64)
            query, candidate, score, nth = _ranked(*(np.concatenate(x) for x in zip(found[at], (query, own[row], scores), strict=True)))
            keep, full = nth < k, query[nth == k - 1]
            found[at] = [query[keep], candidate[keep], score[keep]]
            known = floor[part]
            known[full] = np.maximum(known[full], score[nth == k - 1])
    whole = [(query_ids[part][query], candidate, score) for part, (query, candidate, score) in zip(parts, found, strict=True)]
    return tuple(np.concatenate(x) for x in zip(*whole, strict=True))


def _ranked(query: np.ndarray, candidate: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (query, candidate) once with its best score, best ones first, and the place within its query."""
    order = np.lexsort((-score, candidate, query))
    query, candidate, score = query[order], candidate[order], score[order]
    once = np.append(True, (query[1:] != query[:-1]) | (candidate[1:] != candidate[:-1]))[: len(query)]
    query, candidate, score = query[once], candidate[once], score[once]
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    return query, candidate, score, np.arange(len(query)) - np.searchsorted(query, query)


def _cell(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        ids = rows["id"].to_numpy()
        vectors = np.stack(rows["v"].to_numpy())
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        query, candidate, score = best(ids[~asks], vectors[~asks], ids[asks], vectors[asks], k)
        return pd.DataFrame({"query_id": query, "vec_id": candidate, "score": score})

    return run


def top_k(vectors: DataFrame, asked: str, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by the inner product of
    floor(scale * component), ties to smaller ids. `asked` is a SQL condition on the id column.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids;
    vectors of different lengths don't meet. Rows of the same id don't answer each other; they are one candidate,
    and one query, with the best score of any of them. Fewer than k others: all of them. An empty table gives no
    rows. Other columns are not read.
    """
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where(F.col(id_col).isNotNull() & finite(vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"), whole.alias("v"), F.expr(asked).alias("asked"))
    rows = materialize(rows.withColumn("width", F.size("v")).dropDuplicates(["id", "v"]), "vectors")
    counts = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = F.greatest(F.ceil(F.col("n") / CELL), F.least(F.lit(tasks), F.ceil(F.col("n") / SMALL_CELL))).cast("int")
    asks = F.ceil(F.greatest("q", F.lit(1)) / QUERIES).cast("int")
    rows = rows.join(counts.select("width", cells.alias("cells"), asks.alias("parts")), "width")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    # every row is a candidate in each part of the queries; every query meets each cell of candidates
    candidates = rows.select("width", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), cell.alias("cell"),
                             F.lit(False).alias("asks"), "id", "v")
    queries = rows.where("asked").select("width", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
                                         F.lit(True).alias("asks"), "id", "v")
    # cells are heavy for their bytes: a number given here isn't merged for their size
    dealt = candidates.union(queries).repartition(tasks, "width", "part", "cell")
    found = dealt.groupBy("width", "part", "cell").applyInPandas(
        _cell(k), "query_id bigint, vec_id bigint, score bigint")
    # a cell has each query's k best, so k rows a query and cell meet here
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
