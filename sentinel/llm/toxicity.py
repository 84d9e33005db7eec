"""Toxicity: a weighted finite-state grammar over clauses, its weights learned from labelled documents.

Word acceptors map words to symbols: insult patterns (whole words or word beginnings, learned and seeded),
threats, targets, negations, reported speech. Cue transducers remember a symbol for some words of the
clause, and the composed machine weighs each insult or threat by the cues that are open: aimed at a target
it counts more, negated or reported it counts less. Isolated words without their clause don't decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sentinel.llm.words import slices

#: Labelled rows that the classifier is fitted on, at most; chosen by a hash, so independent of order.
SAMPLE = 12_000
#: A learned pattern is in so many toxic documents at least, and its frequency in toxic texts is at least e^LIFT times
#: that in clean ones; were a document with it only RATIO times as likely to be toxic as any document, the chance to
#: see so many toxic ones would be below CHANCE.
SUPPORT, LIFT, RATIO, CHANCE = 3, 2.0, 1.25, 1e-3
#: Documents up to which that chance is summed term by term; beyond, a bound is near enough.
SUMMED = 200
#: Lengths of learned word beginnings.
STEMS = range(3, 9)

# Seed words of the grammar.
INSULTS = "asshole bastard bitch coward cretin disgusting dumb fool freak garbage idiot imbecile jerk liar loser moron pathetic pig scum stupid trash ugly useless vermin worthless".split()
THREATS = "beat burn destroy hunt hurt kill punish shoot stab strangle".split()
TARGETS = "you your yours yourself u ur he him she her they them everyone these those".split()
NEGATIONS = "not no never isn aren wasn weren don doesn didn won nicht kein keine ne pas nunca".split()
REPORTS = "said says say called calls wrote writes quoted quote quotes claimed claims according alleged".split()

OTHER, BREAK, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
_TOKENS = re.compile(r"\w+|[.!?;:,\n]").findall
_WORDS = re.compile(r"\w+").findall
#: Words a cue stays open; what an open cue makes of the weight.
REACH = {TARGET: 4, NEGATION: 3, REPORT: 8}
AIMED, NEGATED, REPORTED = 1.5, 0.3, 0.5
SEED_WEIGHT, THREAT_WEIGHT = 3.0, 3.0


@dataclass(frozen=True)
class Grammar:
    """Insult patterns with weights (`word$` is a whole word, others word beginnings) and the final scale."""

    patterns: dict[str, float]
    scale: tuple[float, ...]


#: Used where no labels teach anything else.
UNTAUGHT = (-4.0, 2.0, 0.5, 1.0)


class Acceptor(dict):
    """Word to (symbol, weight): the longest pattern that accepts the word. Remembers a bounded number of words."""

    def __init__(self, patterns: dict[str, float], most: int = 200_000):
        super().__init__()
        self.patterns, self.most = patterns, most
        self.fixed = {w: (s, 0.0) for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.fixed |= {w: (THREAT, THREAT_WEIGHT) for w in THREATS}
        self.fixed |= {c: (BREAK, 0.0) for c in ".!?;:,\n"}

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) > self.most:
            self.clear()
        found = self.fixed.get(word)
        weight = self.patterns.get(word + "$")
        for n in reversed(STEMS):
            if weight is not None:
                break
            if len(word) >= n:
                weight = self.patterns.get(word[:n])
        if weight is not None and (found is None or found[0] == THREAT):
            found = (INSULT, weight)
        self[word] = found
        return found


def clauses(symbols: list[tuple[int, float] | None]) -> Iterator[float]:
    """Weight of each clause that matches: the composed transducers, one step a word."""
    total, far = 0.0, {TARGET: 99, NEGATION: 99, REPORT: 99}
    pending = 0.0  # weight that a target right after it would still raise
    for symbol in symbols:
        for cue in far:
            far[cue] += 1
        if symbol is None:
            continue
        kind, weight = symbol
        if kind == BREAK:
            if total:
                yield total
            total, pending, far = 0.0, 0.0, {TARGET: 99, NEGATION: 99, REPORT: 99}
        elif kind in far:
            far[kind] = 0
            if kind == TARGET and pending:
                total, pending = total + (AIMED - 1) * pending, 0.0
        else:
            # a threat without a target in its clause doesn't count until one comes
            open_ = {cue for cue, n in far.items() if n <= REACH[cue]}
            value = weight * (NEGATED if NEGATION in open_ else 1) * (REPORTED if REPORT in open_ else 1)
            if kind == INSULT:
                total += value * (AIMED if TARGET in open_ else 1)
                pending = 0.0 if TARGET in open_ else value
            elif TARGET in open_:
                total += value
            else:
                pending = 2 * value
    if total:
        yield total


def measures(text: str, accept: Acceptor) -> tuple[float, float, float]:
    """Of a text: log of its clauses' weights together, the same a word, and log of its heaviest clause."""
    tokens = _TOKENS(text.lower())
    symbols = list(map(accept.__getitem__, tokens))
    weights = [w for w in clauses(symbols) if w > 0] if any(s is not None and s[0] >= THREAT for s in symbols) else []
    if not weights:
        return 0.0, 0.0, 0.0
    total = sum(weights)
    return math.log1p(total), math.log1p(100 * total / len(tokens)), math.log1p(max(weights))


def _patterns_of(word: str) -> Iterator[str]:
    yield word + "$"
    for n in STEMS:
        if len(word) >= n:
            yield word[:n]


def _count(only: frozenset[str] | None):
    """Pattern counts of a task's texts: occurrences, and documents that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, docs, total, texts = Counter(), Counter(), 0, 0
        for batch in batches:
            texts += batch.num_rows
            for text in batch.column("text"):
                words = Counter(_WORDS((text.as_py() or "").lower()))
                total += sum(words.values())
                own = Counter()
                for word, n in words.items():
                    for p in _patterns_of(word):
                        if only is None or p in only:
                            own[p] += n
                times.update(own)
                docs.update(own.keys())
        keys = list(times)
        yield pa.record_batch([pa.array(["", *keys]), pa.array([total, *(times[k] for k in keys)], pa.int64()),
                               pa.array([texts, *(docs[k] for k in keys)], pa.int64())], names=["pattern", "times", "docs"])

    return run


def _counts(texts: DataFrame, only: frozenset[str] | None, least: int) -> dict[str, tuple[int, int]]:
    """Occurrences and documents of the patterns in at least so many documents, and under "" the words and
    documents of all; bounded by the sample."""
    found = texts.select("text").mapInArrow(_count(only), "pattern string, times bigint, docs bigint")
    rows = found.groupBy("pattern").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    return {"": (0, 0)} | {r.pattern: (r.times, r.docs) for r in rows.where((F.col("docs") >= least) | (F.col("pattern") == "")).collect()}


def _chance(k: int, n: int, p: float) -> float:
    """The chance of k or more of n, for large n an upper bound of it (Chernoff)."""
    x = k / n
    if x <= p:
        return 1.0
    if n <= SUMMED:
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
    rest = (1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0.0
    return math.exp(-n * (x * math.log(x / p) + rest))


def _lifts(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log ratio of a word's frequency in toxic and clean texts, for patterns whose documents prove one.

    Of patterns in nearly the same documents the longest stays: `trash$`, not `tra`.
    """
    (words1, docs1), (words0, docs0) = toxic[""], clean[""]
    out, longer = {}, Counter()
    for p, (n1, d1) in toxic.items():
        n0, d0 = clean.get(p, (0, 0))
        if p and _chance(d1, d1 + d0, min(0.9, RATIO * docs1 / (docs1 + docs0))) <= CHANCE:
            lift = math.log((n1 + 0.5) / (words1 + 1)) - math.log((n0 + 0.5) / (words0 + 1))
            if lift >= LIFT:
                out[p] = min(lift, 8.0)
                stem = p.rstrip("$")
                for n in STEMS:
                    if n < len(p) and n <= len(stem):
                        longer[stem[:n]] = max(longer[stem[:n]], d1)
    return {p: w for p, w in out.items() if longer[p] < 0.95 * toxic[p][1]}


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by damped Newton steps, weights held near the untaught ones where data say little."""
    prior = np.array(UNTAUGHT)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Patterns and scale from the labelled documents that are not held out, at most `sample` of them.

    Patterns are learned on two thirds of these and the scale is fitted on the other third, so that a
    pattern's luck with its own documents doesn't count. Of repeated labels the highest holds.
    """
    taught = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = taught.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(taught, "doc_id").where("text is not null")
    rows = rows.dropDuplicates(["text"])  # copies prove nothing twice
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))).select("text", "toxic", "fold").persist()
    first = rows.where("fold > 0")
    toxic = _counts(first.where("toxic = 1"), None, SUPPORT)
    clean = _counts(first.where("toxic = 0"), frozenset(toxic), 0)
    patterns = {w + "$": SEED_WEIGHT for w in INSULTS} | (_lifts(toxic, clean) if clean[""][1] else {})
    patterns = _shortest(patterns)
    tuned = rows.where("fold = 0").select("text", "toxic").mapInArrow(_measured(patterns), "a double, b double, c double, toxic int")
    data = np.array([tuple(r) for r in tuned.collect()], float).reshape(-1, 4)
    rows.unpersist()
    if not len(data) or len(set(data[:, 3])) < 2:
        return Grammar(patterns, UNTAUGHT)
    x = np.column_stack([np.ones(len(data)), data[:, :3]])
    return Grammar(patterns, tuple(float(w) for w in _regress(x, data[:, 3])))


def _shortest(patterns: dict[str, float]) -> dict[str, float]:
    """Without patterns that a shorter one already accepts at nearly the same weight."""
    out = {}
    for p in sorted(patterns, key=lambda p: (len(p), p)):
        stem = p.rstrip("$")
        known = next((out[stem[:n]] for n in range(len(stem), 2, -1) if stem[:n] in out), None)
        if known is None or abs(known - patterns[p]) > 0.5:
            out[p] = patterns[p]
    return out


def _measured(patterns: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = Acceptor(patterns)
        for batch in batches:
            found = [measures(t.as_py(), accept) for t in batch.column("text")]
            yield pa.record_batch([*(pa.array([f[i] for f in found], pa.float64()) for i in range(3)),
                                   batch.column("toxic").cast(pa.int32())], names=["a", "b", "c", "toxic"])

    return run


def held_out(id_col: str):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Documents with `score` (0 to 1) and `predicted` (1 from the threshold on), from the whole text only.

    Null and empty texts match no clause and get the score of such. Repeated rows score alike. Result
    columns replace columns of the same name; other columns pass.
    """
    patterns, scale = grammar.patterns, grammar.scale
    base = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = Acceptor(patterns)
        for batch in batches:
            for lo, hi in slices(batch.column(text_col)):
                part = batch.slice(lo, hi - lo)
                values = []
                for text in part.column(text_col):
                    found = measures(text.as_py() or "", accept)
                    z = scale[0] + sum(w * x for w, x in zip(scale[1:], found, strict=True))
                    values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                yield pa.record_batch([*part.columns, pa.array(values, pa.float64()),
                                       pa.array([int(v >= threshold) for v in values], pa.int32())],
                                      names=[*part.schema.names, "score", "predicted"])

    schema = StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return base.mapInArrow(run, schema)
