"""Sharding by histogram sort: splitters found by exact byte counts below probes, then one exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.session import materialize

#: Hexadecimal digits of the first probes and of each refinement; distance from the wanted boundary that
#: is near enough, as a share of a shard; rows numbered in one task, about.
FIRST, MORE, TOLERANCE, PART = 3, 2, 0.001, 8192
#: Bytes that a document counts besides its text.
OVERHEAD = 16
_DIGITS = 32


def sort_key(text: Column, ident: Column) -> Column:
    """Text hash, then id hash, as hexadecimal digits: equal texts lie together, and can still be told apart."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(ident, text)), 16, "0")))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """Boundaries of (key, size) rows, so that sizes between them are nearly equal.

    A probe is a key prefix. Each pass counts the bytes of the prefixes that still hold a boundary, one level
    deeper; these are `shards` - 1 prefixes at most, so a pass returns a bounded number of sums. A boundary is
    set where a prefix begins or ends near enough; equal keys are never parted.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    near = tolerance * total / shards
    # boundary number: (wanted bytes below it, prefix that holds it, bytes below that prefix)
    todo = {i: (total * i / shards, "", 0) for i in range(1, shards)}
    done: dict[int, str] = {}
    held, digits = 0, FIRST
    while todo:
        rows = keys
        if held:
            rows = keys.where(F.substring("key", 1, held).isin(sorted({p for _, p, _ in todo.values()})))
        probes = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
            F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("one"))
        sums: dict[str, list] = {}
        for r in probes.orderBy("prefix").collect():
            sums.setdefault(r.prefix[:held], []).append(r)
        for i, (wanted, parent, below) in list(todo.items()):
            for r in sums.get(parent, []):
                if below + r.bytes >= wanted:
                    before, after = wanted - below, below + r.bytes - wanted
                    if min(before, after) <= near or r.one:
                        # "g" sorts after all digits: the prefix lies below the boundary
                        done[i] = r.prefix if before <= after else r.prefix + "g"
                        del todo[i]
                    else:
                        todo[i] = (wanted, r.prefix, below)
                    break
                below += r.bytes
            else:  # no rows at all
                done[i] = "g"
                del todo[i]
        held, digits = digits, min(_DIGITS, digits + MORE)
    return [done[i] for i in sorted(done)]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Documents with `size`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Sizes are the text's UTF-8 bytes plus 16; shards get nearly equal bytes. Equal texts stay in one shard
    unless a boundary has to part them to be near enough. Null text: size 16. Rows with equal id and text
    stay together. Fewer documents than shards: some shards are empty. Result columns replace columns of the
    same name; other columns pass.
    """
    key = sort_key(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("bigint")
    base = docs.drop("size", "shard", "slot").withColumns({"_key": key, "size": size})
    keys = materialize(base.select(F.col("_key").alias("key"), "size"), "keys")
    bounds = F.array(*[F.lit(s) for s in splitters(keys, shards, tolerance)]) if shards > 1 else F.array().cast("array<string>")
    place = lambda k: F.size(F.filter(bounds, lambda s: s <= k))
    parts = max(1, math.ceil(keys.count() / shards / PART))
    part = lambda k: F.pmod(F.xxhash64(k), F.lit(parts))

    counts = keys.groupBy(place(F.col("key")).alias("shard"), part(F.col("key")).alias("part")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("shard", F.col("part").alias("_part"), (upto - F.col("n")).alias("_before"))
    placed = base.withColumn("shard", place(F.col("_key"))).withColumn("_part", part(F.col("_key")))
    nth = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key"))
    joined = placed.withColumn("_nth", nth).join(counts, ["shard", "_part"])
    slot = (F.col("_before") + F.col("_nth") - 1).cast("bigint")
    return joined.withColumn("slot", slot).drop("_key", "_part", "_nth", "_before")
