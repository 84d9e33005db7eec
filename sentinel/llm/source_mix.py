"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents, in shuffled order, form one stream of words that is cut into equal blocks. Slot t of
the schedule is the golden-ratio point t; cumulative target weights map it to a source. The r-th slot of a
source takes block r of it, and starts over when they end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinel.session import materialize

#: Words of a block; fewer where the corpus has less than a million blocks.
BLOCK, BLOCKS = 64, 1 << 20
#: 2**31 over the golden ratio, odd: slots go through all points of the circle in even steps.
CIRCLE, STEP = 1 << 31, 1327217885
#: Slots of a chunk, cells of the guide table, documents of a prefix-sum bucket.
CHUNK, GUIDE, BUCKET = 1 << 16, 1 << 10, 8192
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in code
    point order, nulls last. A target stops at `most` times its source; the excess goes to the others by weight.

    Sources capped are those of least cap per weight; the water level is the highest that any prefix of them
    leaves. One window over the sources, never over documents.
    """
    numbered = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    caps = numbered.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = caps.withColumn("level", left / weight_left)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least("cap", F.col("w") * F.greatest(level, F.lit(0.0))).alias("target"))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(source, slot, rank): the source of each slot and which of its slots this is.

    `plan` has source and target. Points find their source over a guide table: circle cells with the sources
    that begin, end or lie in them. Ranks are counted per chunk and added up, so a source with most of the
    slots isn't ranked in one task.
    """
    spark = plan.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = F.sum("target").over(Window.partitionBy())
    high = F.round(F.sum("target").over(order) / whole * CIRCLE).cast("bigint")
    bounds = plan.where("target > 0").select("source", high.alias("high"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0).cast("bigint"))).where("high > low")
    wide = CIRCLE // GUIDE
    guide = bounds.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(high - 1) div {wide}"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE * STEP) % CIRCLE).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {wide}"))
    placed = points.join(guide, "cell").where("point >= low and point < high").select(
        "source", "slot", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = placed.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (so_far - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))
    ranked = placed.withColumn("inside", inside)
    joined = ranked.join(counts, ranked.source.eqNullSafe(counts.s) & (ranked.chunk == counts.c))
    return joined.select("source", "slot", (F.col("before") + F.col("inside") - 1).alias("rank"))


def streams(sized: DataFrame, documents: int) -> DataFrame:
    """Adds `begin`, the words of the source before a document in its shuffled order.

    Order is that of a hash of the id. Documents fall into ranges of the hash; sums of ranges are added up
    per source and those of documents per range, so a large source is spread over tasks.
    """
    bits = max(0, math.ceil(math.log2(max(1, documents) / BUCKET)))
    hashed = sized.withColumn("h", F.xxhash64("doc", F.lit(17)))
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    hashed = hashed.withColumn("bucket", bucket)
    totals = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (upto - F.col("n")).alias("earlier"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc", "size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.withColumn("inner", F.sum("size").over(inner) - F.col("size"))
    joined = summed.join(totals, summed.source.eqNullSafe(totals.s) & (summed.bucket == totals.b))
    return joined.withColumn("begin", F.col("earlier") + F.col("inner")).select("doc", "source", "mark", "size", "begin")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc, mark, source, size, source_size, target, passes, taken), one row per input row; `passes` are the
    words taken of the document in each pass over its source (always its first ones), `taken` their sum.

    `mark` is the text's hash and tells rows of one id apart. Null text: no words, none taken. Null source:
    a source of its own. Repeated rows are documents like others. Without any word all targets are 0. Null
    ids are shuffled together. Reruns agree, as order depends on ids and texts only.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    sized = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(source_col).alias("source"),
                                    F.xxhash64(text_col).alias("mark"), size.alias("size")), "sizes")
    documents, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    block = max(1, min(BLOCK, words // BLOCKS))
    placed = materialize(streams(sized, documents), "streams")

    taken = schedule(plan, round(share * words / block))
    count = F.ceil(F.col("source_size") / block)
    sources = plan.select(F.col("source").alias("s"), count.alias("blocks"))
    taken = taken.join(sources, taken.source.eqNullSafe(sources.s)).where(F.col("rank") < most * F.col("blocks")).select(
        "source", F.expr("rank div blocks").alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))
    last = F.col("begin") + F.col("size") - 1
    pieces = placed.where("size > 0").select(
        "source", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("at"))
    overlap = F.least(last + 1, (F.col("at") + 1) * block) - F.greatest("begin", F.col("at") * block)
    pieces = pieces.select(F.col("source").alias("s"), "begin", "at", overlap.alias("words"))
    met = pieces.join(taken, pieces.s.eqNullSafe(taken.source) & (pieces["at"] == taken.block))
    sums = met.groupBy("s", "begin").agg(*[F.coalesce(F.sum(F.when(F.col("pass") == p, F.col("words"))), F.lit(0).cast("bigint")).alias(f"p{p}")
                                           for p in range(most)])
    sums = sums.select("s", F.col("begin").alias("from"), F.array(*[f"p{p}" for p in range(most)]).alias("passes"))
    out = placed.join(sums, placed.source.eqNullSafe(sums.s) & (placed.begin == sums["from"]) & (placed["size"] > 0), "left")
    nothing = F.array(*[F.lit(0).cast("bigint") for _ in range(most)])
    out = out.withColumn("passes", F.coalesce("passes", nothing)).drop("s", "from", "begin")
    shares = plan.withColumnRenamed("source", "s")
    out = out.join(shares, out.source.eqNullSafe(shares.s)).drop("s")
    return out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("bigint"), lambda a, x: a + x))


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: a document once for each pass that takes words of it, cut to these words where a
    block ends inside it. Columns are those of the documents; a text that is cut has one space between words."""
    base = docs.columns
    # rows of equal id and text are interchangeable: the n-th of them takes the n-th plan
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[0]))
    chosen = plan.where("taken > 0").select("doc", "mark", F.col("size").alias("_size"), "passes", nth("doc", "mark").alias("nth"))
    numbered = docs.withColumn("_doc", F.col(id_col).cast("bigint")).withColumn("_mark", F.xxhash64(text_col))
    numbered = numbered.withColumn("_nth", nth("_doc", "_mark"))
    joined = numbered.join(chosen.hint("merge"), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark")) & (F.col("_nth") == F.col("nth")))
    each = joined.select(*[numbered[c] for c in base], "_size", F.explode("passes").alias("_words")).where("_words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") == F.col("_size"), F.col(text_col)).otherwise(cut)
    return each.withColumn(text_col, text).select(*base)
