"""Compact exchange of many (hash, owner, place) entries: packed blocks instead of a Spark row each.

A task sorts its entries into hash ranges (buckets) and sends one binary row per bucket and flush. Spark
shuffles these rows by bucket like any others, and can rebuild them like any others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, payload binary"
#: Entries a task gathers before it sends blocks, and text bytes behind one bucket at most.
FLUSH_ENTRIES = 1_000_000
BUCKET_BYTES = 256_000_000


def bucket_count(texts: DataFrame, column: str = "text") -> int:
    """Buckets so that one fits in a task: one a shuffle partition, more for very large inputs."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, math.ceil(total / BUCKET_BYTES))


def _put(out: list[bytes], values: np.ndarray) -> None:
    """Unsigned integers in the fewest bytes each."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    raw = values.astype(kind)
    out.append(np.array([len(raw), raw.itemsize], np.uint32).tobytes())
    out.append(raw.tobytes())


def _take(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, size = (int(x) for x in np.frombuffer(raw, np.uint32, 2, at))
    return np.frombuffer(raw, f"u{size}", n, at + 8), at + 8 + n * size


def pack(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, names: list[np.ndarray],
         buckets: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of entries sorted by (owner, place); `names` are integer columns of the owners.

    A block keeps the low `width` bytes of a hash; the bucket is taken from the high ones.
    """
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[b]: cuts[b + 1]]
        owners, counts = np.unique(owner[own], return_counts=True)
        gaps = np.diff(place[own], prepend=0)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        gaps[starts] = place[own[starts]]
        parts: list[bytes] = []
        _put(parts, counts)
        _put(parts, gaps)
        for name in names:
            _put(parts, name[owners].astype(np.int64).view(np.uint64))
        small = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
        low = hashes[own].view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([len(own), len(small), sum(map(len, parts))], np.uint32).tobytes()
        yield int(b), head + small + low.tobytes()


def unpack(payloads: list[bytes], width: int, names: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes, places and owner columns of all entries of some blocks of one bucket."""
    hashes, places, columns = [], [], [[] for _ in range(names)]
    for raw in payloads:
        n, small, plain = (int(x) for x in np.frombuffer(raw, np.uint32, 3))
        part = pa.decompress(raw[12: 12 + small], decompressed_size=plain, codec="zstd", asbytes=True)
        counts, at = _take(part, 0)
        gaps, at = _take(part, at)
        counts, gaps = counts.astype(np.int64), gaps.astype(np.int64)
        sums = np.cumsum(gaps)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        places.append(sums - np.repeat(sums[starts] - gaps[starts], counts))
        for column in columns:
            values, at = _take(part, at)
            column.append(np.repeat(values.astype(np.uint64).view(np.int64), counts))
        wide = np.zeros((n, 8), np.uint8)
        if width:
            wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, 12 + small).reshape(n, width)
        hashes.append(wide.view(np.uint64).ravel())
    return np.concatenate(hashes), np.concatenate(places), [np.concatenate(c) for c in columns]


def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
                           names=["bucket", "payload"])
