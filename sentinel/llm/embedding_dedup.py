"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one kept of each group.

A vector belongs to the cell of its nearest centre, and is also shown to each cell whose border is so near
that a vector across it could be similar: if cos(x, y) >= t then |x - y| <= sqrt(2 - 2t) for unit vectors,
so y lies at most that far beyond the plane between its own and x's centre. So no link is lost to a border.

Borders hold for both vectors of a link, so it is enough that the one of the lower cell visits the other's:
each pair meets once. How many cells there are is decided by what they cost: many cells save products where
vectors lie in clumps, but where they lie evenly most cells border on most others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.llm.components import components
from sentinel.llm.vectors import finite, matrix
from sentinel.session import materialize

#: Vectors the centres are fitted on, at most, and their bytes; numbers of cells to choose from, and how many vectors of the
#: sample a cell has at least. Neither bound loses a link.
SAMPLE, SAMPLE_BYTES, CENTRES, LEAST, ROUNDS = 20_000, 64 << 20, (4, 16, 64, 256), 16, 8
#: Vectors of a cell compared at once, at most, and their bytes; more are compared in parts. Products held at once.
PART, PART_BYTES, SLICE = 4096, 16 << 20, 1024
#: Products that cost as much as it costs to send a vector once.
WORTH = 1000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly taken rows; a centre that gets no vector stays."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def part_rows(width: int) -> int:
    return max(2, min(PART, PART_BYTES // (8 * width)))


def _borders(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which cells it may have similar vectors in."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    near = vectors @ centres.T
    own = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[own] + 1e-7  # more than the root loses near 0
    shown = (near[np.arange(len(own)), own][:, None] - near) <= reach * apart + 1e-9
    shown[np.arange(len(own)), own] = True
    return own, shown


def choose_centres(sample: np.ndarray, threshold: float, peers: float) -> np.ndarray:
    """Centres whose cells cost least for vectors that have so many peers (of the same label) each.

    A vector is sent once for each cell it is shown to and each part it meets there, and multiplied with the
    share of its peers that lies in those cells.
    """
    best = None
    for k in CENTRES:
        if best is not None and k * LEAST > len(sample):
            break
        centres = fit_centres(sample, min(k, len(sample)))
        shown = _borders(sample[:: max(1, len(sample) // 2000)], centres, threshold)[1].sum(axis=1).mean()
        met = peers * shown / len(centres)
        cost = shown / 2 + met / part_rows(sample.shape[1]) + met / 2 / WORTH
        if best is None or cost < best[0]:
            best = (cost, centres)
    return best[1]


def _assign(centres: np.ndarray, threshold: float):
    """Adds to each vector its cell and the higher cells that it visits."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, shown = _borders(unit(matrix(batch.column("v"), width)), centres, threshold)
            row, cell = np.nonzero(shown & (np.arange(len(centres)) > own[:, None]))
            cuts = np.searchsorted(row, np.arange(len(own) + 1))
            others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cell, pa.int32()))
            yield pa.record_batch([*batch.columns, pa.array(own, pa.int32()), others], names=[*batch.schema.names, "home", "others"])

    return run


def _links(threshold: float):
    """Of a part of a cell's vectors and another part of these or of its visitors: how many rows each vector
    links to (its own id as peer), and links that connect what these connect. With `j` = `i` it is one part."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        same = key[2] == key[3]
        left, right = (rows, rows) if same else (rows[rows["left"]], rows[~rows["left"]])
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "links": [], "peer": []})
        x = unit(np.stack(left["v"].to_numpy()))
        y = x if same else unit(np.stack(right["v"].to_numpy()))
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        near = np.empty((len(x), len(y)), bool)
        for at in range(0, len(x), SLICE):
            near[at:at + SLICE] = x[at:at + SLICE] @ y.T >= threshold
            near[at:at + SLICE] &= ids[at:at + SLICE, None] != other[None, :]
        if same:  # products of the two orders may differ in their last bit
            near |= near.T
        found = [_counted(near, ids, right["times"].to_numpy())]
        if not same:
            found.append(_counted(near.T, other, left["times"].to_numpy()))
        chain = _chain(near, ids, other)
        return pd.concat([*found, pd.DataFrame({"id": chain[:, 0], "links": 0, "peer": chain[:, 1]})])

    return run


def _counted(near: np.ndarray, ids: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """Rows that each vector links to, where there are any."""
    row, column = np.nonzero(near)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, row, times[column])
    return pd.DataFrame({"id": ids, "links": links, "peer": ids})[links > 0]


def _chain(near: np.ndarray, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Fewest links (row id, peer id) that connect rows and columns as `near` does."""
    links, todo = [], near.any(axis=1)
    seen = np.zeros(len(other), bool)
    for start in np.flatnonzero(todo):
        if not todo[start]:
            continue
        front = np.array([start])
        todo[start] = False
        while len(front):
            columns = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[columns] = True
            links += [(ids[start], other[c]) for c in columns]
            front = np.flatnonzero(near[:, columns].any(axis=1) & todo)
            todo[front] = False
            links += [(ids[f], ids[start]) for f in front]
    return np.array(links, np.int64).reshape(-1, 2)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row: links are pairs of equal, non-null
    labels and equal lengths whose cosine in double precision is at least the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    link with nothing and are kept. Equal vectors of a label are compared once and counted as often as they
    occur. Rows that repeat an id count as one vector each for the links of others. Null id: no links,
    component null, kept null. An empty table gives none. Very long vectors are compared in smaller parts.
    """
    spark = vectors.sparkSession
    v = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    usable = finite("v") & F.exists("v", lambda x: x != 0.0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(usable)
    # equal vectors: one stands for all; the direct links among them are their number
    classes = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    classes = materialize(classes.withColumn("width", F.size("v")), "classes")
    same = good.join(classes.select("label", "v", F.col("id").alias("rep"), "times"), ["label", "v"]).select("id", "rep", "times")

    edges = spark.createDataFrame([], "id bigint, label string, links bigint, peer bigint")
    labels = classes.groupBy("width", "label").count()
    for width, peers in labels.groupBy("width").agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).collect():
        own = classes.where(F.col("width") == width)
        fitted = own.orderBy(F.xxhash64("id")).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("v").toArrow().column("v").combine_chunks()
        centres = choose_centres(unit(matrix(fitted, width)), threshold, peers)
        assigned = own.select("id", "label", "times", "v").mapInArrow(
            _assign(centres, threshold), "id bigint, label string, times bigint, v array<double>, home int, others array<int>")
        assigned = materialize(assigned, "assigned")
        homes = assigned.withColumn("cell", F.col("home"))
        visits = assigned.withColumn("cell", F.explode("others"))
        size = part_rows(width)
        sizes = assigned.select("label", F.explode(F.concat(F.array("home"), "others")).alias("cell"), "home").groupBy("label", "cell").agg(
            F.ceil(F.count_if(F.col("home") == F.col("cell")) / size).cast("int").alias("parts"),
            F.ceil(F.count_if(F.col("home") != F.col("cell")) / size).cast("int").alias("guests"))
        met = ["label", "cell", "i", "j", "left", "id", "times", "v"]

        def parted(rows: DataFrame, parts: str) -> DataFrame:
            # the right-hand table is small, one row a cell; each vector falls into one part of its cell
            return rows.join(sizes, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))

        # parts 0 to parts - 1 are the cell's own, the following ones its guests: i is an own part, j an own one
        # from i on or a guest
        homes = parted(homes, "parts")
        as_left = homes.withColumn("i", F.col("part")).withColumn("left", F.lit(True)).withColumn(
            "j", F.explode(F.expr("sequence(part, parts + guests - 1)")))
        as_right = homes.where("part > 0").withColumn("j", F.col("part")).withColumn("left", F.lit(False)).withColumn(
            "i", F.explode(F.expr("sequence(0, part - 1)")))
        as_guest = parted(visits, "guests").where("parts > 0").withColumn("j", F.col("parts") + F.col("part")).withColumn(
            "left", F.lit(False)).withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
        placed = as_left.select(*met).union(as_right.select(*met)).union(as_guest.select(*met))
        found = placed.groupBy("label", "cell", "i", "j").applyInPandas(_links(threshold), "id bigint, links bigint, peer bigint")
        edges = edges.union(found.select("id", F.lit(None).cast("string"), "links", "peer"))
    edges = materialize(edges.drop("label"), "links")
    groups = components(edges.select("id", "peer").union(same.select("id", F.col("rep").alias("peer"))), "id", "peer")
    direct = edges.groupBy("id").agg(F.sum("links").alias("links"))
    linked = same.join(direct.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.select("id").join(linked, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
