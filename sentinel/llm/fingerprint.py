"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of a text.

A paragraph is a line with its line feed, a piece a part of it that ends at a punctuation mark or after PIECE
characters. A paragraph's digest is that of its pieces' digests; a section is a run of paragraphs up to one whose
digest ends in 0, so that an edit moves no later section; the root is the digest of the sections' digests.

A fingerprint is text: the root's 64 digits, then sections `#digest=` of paragraphs `pieces:digest;`, with shortened
digests. The root is made of whole ones: equal roots mean equal texts. Two trees are compared from the root down,
and only where digests differ. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.session import materialize

#: Characters of a piece before its mark at most; digits shown of pieces, of paragraphs and sections, of the root.
PIECE, PIECE_DIGITS, BRANCH_DIGITS, ROOT_DIGITS = 80, 8, 16, 64
PIECES = rf"(?s).{{1,{PIECE}}}?[.!?;:,\n] ?|.{{1,{PIECE}}}"
LINES = r"[^\n]*\n|[^\n]+"
WHOLE = 2**31 - 1


def _paragraph(line: Column) -> Column:
    """`pieces:digest;`, the digest being that of the pieces' whole digests."""
    digests = F.transform(F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)), lambda p: F.sha2(p, 256))
    # an array of one, so that the digests are computed once
    return F.transform(F.array(digests), lambda d: F.concat(
        F.array_join(F.transform(d, lambda x: F.substring(x, 1, PIECE_DIGITS)), ""), F.lit(":"),
        F.sha2(F.array_join(d, ""), 256), F.lit(";")))[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null is the empty text, whose tree is a root alone."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINES), F.lit(0))
    paragraphs = F.array_join(F.transform(lines, _paragraph), "")
    sections = F.filter(F.split(F.replace(paragraphs, F.lit("0;"), F.lit("0;#")), "#"), lambda s: s != "")
    trees = F.transform(sections, lambda s: F.struct(
        F.sha2(F.regexp_replace(s, "[0-9a-f]*:", ""), 256).alias("digest"),
        F.regexp_replace(s, rf":([0-9a-f]{{{BRANCH_DIGITS}}})[0-9a-f]*;", ":$1;").alias("shown")))
    return F.transform(F.array(trees), lambda all_of: F.concat(
        F.sha2(F.array_join(F.transform(all_of, lambda t: t.digest), ""), 256),
        F.array_join(F.transform(all_of, lambda t: F.concat(F.lit("#"), F.substring(t.digest, 1, BRANCH_DIGITS), F.lit("="), t.shown)), "")))[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, ROOT_DIGITS)


def sections(fp: Column) -> Column:
    """Sections `digest=paragraphs` of a fingerprint, in order."""
    return F.filter(F.split(F.substring(fp, ROOT_DIGITS + 1, WHOLE), "#"), lambda s: s != "")


def paragraphs(section: Column) -> Column:
    """Paragraphs `pieces:digest` of a section, in order."""
    return F.filter(F.split(F.substring(section, BRANCH_DIGITS + 2, WHOLE), ";"), lambda p: p != "")


def pieces(fp: Column) -> Column:
    """Distinct shortened digests of all pieces."""
    plain = F.regexp_replace(F.substring(fp, ROOT_DIGITS + 1, WHOLE), rf"#[0-9a-f]{{{BRANCH_DIGITS}}}=|:[0-9a-f]{{{BRANCH_DIGITS}}};", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"[0-9a-f]{{{PIECE_DIGITS}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal roots, else twice the distinct pieces in both trees by the sum of each tree's."""
    met = F.transform(F.array(F.struct(pieces(a).alias("a"), pieces(b).alias("b"))), lambda x: F.coalesce(
        2.0 * F.size(F.array_intersect(x.a, x.b)) / F.nullif(F.size(x.a) + F.size(x.b), F.lit(0)), F.lit(0.0)))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(met)


def differing(a: Column, b: Column) -> Column:
    """Where `a` was edited: [section, paragraph], from 0, of its paragraphs that `b` lacks. Branches whose digest
    `b` has are not entered."""
    known = F.transform(sections(b), lambda s: F.substring(s, 1, BRANCH_DIGITS))
    lines = F.transform(F.flatten(F.transform(sections(b), paragraphs)), lambda p: F.substring_index(p, ":", -1))
    at = F.transform(sections(a), lambda s, i: F.when(
        F.array_contains(known, F.substring(s, 1, BRANCH_DIGITS)), F.array().cast("array<array<int>>")).otherwise(F.filter(
            F.transform(paragraphs(s), lambda p, j: F.when(~F.array_contains(lines, F.substring_index(p, ":", -1)), F.array(i, j))),
            lambda x: x.isNotNull())))
    return F.when(root(a) == root(b), F.array().cast("array<array<int>>")).otherwise(F.flatten(at))


def _next(keys: DataFrame) -> DataFrame:
    """(key, take, next): the following key by descending id, the last one's being the first.

    Keys are dealt to ranges of ids; each range is ordered by itself, and the last of a range is followed by the
    first of the next. One row a range is put in order in one place.
    """
    ranged = keys.repartitionByRange(F.col("id").desc_nulls_last(), "key").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    inside = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), "key")
    linked = ranged.withColumns({"next": F.lead("key").over(inside), "before": F.lag("key").over(inside)})
    heads = linked.where("before is null").select("range", "key")
    order = Window.orderBy("range")
    after = heads.select(F.col("range").alias("of"), F.coalesce(F.lead("key").over(order), F.first("key").over(order)).alias("after"))
    # the first head of all follows the last one
    return linked.join(after, F.col("range") == F.col("of")).select("key", "take", F.coalesce("next", "after").alias("next"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint, next_id, next_start, next_fingerprint), one row per input row: `next_start` is as
    much of the beginning of the next document, by descending id, as a third of this one's characters.

    Null text: empty. Rows of one id follow each other by a digest of id and text; repeated rows are one document
    with the same answer. Null ids come last. A single document follows itself. An empty table gives no rows.
    Texts are shuffled once (both sides of the last join read the same exchange, as they need the same columns),
    beginnings of at most a third of them once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    own = own.withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)))
    keys = own.groupBy("id", "key").agg(F.max(F.expr("length(text) div 3")).alias("take"))
    links = materialize(_next(keys), "links").withColumnRenamed("key", "to")
    alike = Window.partitionBy("key").orderBy("key")
    once = own.withColumn("before", F.lag("key").over(alike)).where("before is null")
    start = F.substring(F.col("text"), F.lit(1), F.col("take").cast("int"))
    lent = once.join(links.hint("merge"), F.col("key") == F.col("next")).select(
        "to", F.col("id").alias("next_id"), start.alias("next_start"), fingerprint(F.col("text")).alias("next_fingerprint"))
    met = own.join(lent.hint("merge"), F.col("key") == F.col("to"))
    return met.select(F.col("id").alias(id_col), F.col("text").alias(text_col), fingerprint(F.col("text")).alias("fingerprint"),
                      "next_id", "next_start", "next_fingerprint")
