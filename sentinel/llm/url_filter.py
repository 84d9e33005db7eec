"""URL filters: longest matching rule first, else boosted trees on lexical features of the URL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.session import materialize

#: Distinct labelled URLs that the trees are fitted on, at most; taken in order of a hash.
SAMPLE = 20_000
TREES, DEPTH, SEED = 12, 4, 11
#: Labelled URLs that a suffix without any counts as, at the overall share of blocked ones.
PRIOR = 5.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens",
            "last_label", "last_two_labels", "first_folder"]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule `host/path` that fits, both null if none does."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, folder = rule[: rule.index("/")], rule[rule.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(folder)
        best_rule = F.when(fits, F.lit(rule)).otherwise(best_rule)
        best_verdict = F.when(fits, F.lit(verdict)).otherwise(best_verdict)
    return best_rule, best_verdict


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of its distinct characters."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features that need no statistics, and the suffixes that do; from `url`, `host`, `path`."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return rows.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), F.length(url)), F.lit(0.0)).cast("double"),
        "entropy": _entropy(url), "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "labels": F.size(labels).cast("double"),
        "hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double"),
        "suffix_last_label": F.element_at(labels, -1),
        "suffix_last_two_labels": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "suffix_first_folder": F.regexp_extract("path", r"\A/([^/]*)", 1),
    })


SUFFIXES = ["last_label", "last_two_labels", "first_folder"]


def _statistics(sample: DataFrame, share: float) -> list[DataFrame]:
    """For each kind of suffix, its smoothed share of blocked URLs; at most as many rows as the sample has."""
    return [sample.groupBy(f"suffix_{s}").agg(
        ((F.sum(F.col("blocked") * F.col("weight")) + PRIOR * share) / (F.sum("weight") + PRIOR)).alias(s)) for s in SUFFIXES]


def _with_statistics(rows: DataFrame, statistics: list[DataFrame], share: float) -> DataFrame:
    for name, table in zip(SUFFIXES, statistics, strict=True):
        rows = rows.join(table, f"suffix_{name}", "left").withColumn(name, F.coalesce(name, F.lit(share)))
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    The trees learn from the URLs that a rule decides, up to `sample` distinct ones by a hash of the URL, each
    with the weight of its rows, and judge the others. Where the rules decide none, or all alike, the trees have nothing to learn: `allow`. Null
    URLs have an empty host and path and go to the trees like others. Repeated rows are judged alike.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})

    taught = rows.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("blocked"))
    taught = taught.groupBy("url", "host", "path", "blocked").agg(F.count("*").cast("double").alias("weight"))
    taught = materialize(taught.orderBy(F.xxhash64("url"), "url").limit(sample).coalesce(1), "labelled-urls")
    n, blocked = taught.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("weight"), F.col("blocked") * F.col("weight"))]).first()
    if not 0 < blocked < n:
        return rows.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    share = blocked / n
    featured = lexical(taught)
    statistics = [materialize(s, "suffixes") for s in _statistics(featured, share)]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = assembler.transform(_with_statistics(featured, statistics, share)).select(
        F.col("blocked").alias("label"), "features", "weight")
    training = training.orderBy("features", "label", "weight").coalesce(1)  # one order, so that reruns agree
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(training)

    scored = trees.transform(assembler.transform(_with_statistics(lexical(rows), statistics, share)))
    guessed = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("ruled", guessed).alias("verdict"))
