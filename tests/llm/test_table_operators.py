"""Top-k, embedding dedup, URL filter, mixing, sharding and the pipeline against brute force."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.llm import embedding_dedup, sharding, source_mix, toxicity, topk, url_filter
from sentinel.llm.embedding_dedup import near_vectors
from sentinel.llm.queries import URL_RULES

VECTORS = "vec_id bigint, embedding array<float>, label int, rank string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.RandomState(5)
    base = rng.randn(30, 16)
    rows = []
    for i in range(300):
        v = base[i % 30] + 0.12 * rng.rand() * rng.randn(16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, "clash"))
    rows += [(300 + i, rows[0][1], 0, "clash") for i in range(5)]  # copies
    rows += [(310, [2 * x for x in rows[0][1]], 0, "clash"), (311, None, 0, "clash"), (312, [0.0] * 16, 0, "clash"),
             (313, [math.nan] + [1.0] * 15, 0, "clash"), (314, [None] + [1.0] * 15, 0, "clash"), (315, rows[0][1], None, "clash"),
             (316, [1.0, 2.0], 0, "clash"), (317, [], 0, "clash"), (320, [math.inf] * 16, 0, "clash"), (None, rows[0][1], 0, "clash")]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 32])
def test_top_k_equals_brute_force(vectors, monkeypatch, block):
    rows, frame = vectors
    monkeypatch.setattr(topk, "BLOCK", block)
    whole = {i: [math.floor(64 * x) for x in v] for i, v, *_ in rows if usable(v) and i is not None}
    expected = []
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), c) for c, v in whole.items() if c != q and len(v) == len(whole[q]))
            expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:20])]
    found = topk.top_k(frame, "vec_id % 20 = 0")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_of_few(spark):
    few = spark.createDataFrame([(0, [1.0], 1, ""), (0, [1.0], 1, ""), (1, [1.0], 1, ""), (2, [1.0], 1, "")], VECTORS)
    assert sorted(map(tuple, topk.top_k(few, "vec_id = 0").collect())) == [(0, 1, 1, 4096), (0, 2, 2, 4096)]
    assert topk.top_k(few.limit(0), "vec_id = 0").count() == 0


@pytest.mark.parametrize("part,centres", [(2048, (4, 16)), (16, (16,)), (7, (1,)), (5, (64,))])
def test_embedding_links_equal_brute_force(vectors, monkeypatch, part, centres):
    rows, frame = vectors
    monkeypatch.setattr(embedding_dedup, "PART", part)
    monkeypatch.setattr(embedding_dedup, "CENTRES", centres)
    good = [(i, np.array(v), label) for i, v, label, _ in rows if i is not None and usable(v) and any(v) and label is not None]
    links = {i: set() for i, *_ in rows}
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98:
                links[i].add(j)
    least = {}
    for i in links:
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least[i] = None if i is None else min(seen)
    expected = [(i, len(links[i]), least[i], None if i is None else least[i] == i) for i, *_ in rows]
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert max(len(x) for x in links.values()) > 5


def test_cells_are_chosen_by_what_they_cost():
    rng = np.random.RandomState(5)
    even = embedding_dedup.unit(rng.randn(4000, 64))
    clumps = embedding_dedup.unit(rng.randn(300, 64)[rng.randint(300, size=8000)] + 0.02 * rng.randn(8000, 64))
    assert len(embedding_dedup.choose_centres(even, 0.98, 5_000)) == 4  # borders everywhere: cells don't pay
    assert len(embedding_dedup.choose_centres(even, 0.98, 5_000_000)) > 4
    assert len(embedding_dedup.choose_centres(clumps, 0.98, 50_000)) >= 64
    assert len(embedding_dedup.choose_centres(even[:3], 0.98, 3)) == 3


def test_embedding_dedup_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


# ---- URL filter

def test_urls(spark):
    urls = ["HTTP://WWW.Example.NET/en/1?x=1#y", "https://example.com/de/", "http://a.org/fr/x", "http://a.org/de/x", "http://example.network/en/",
            "nothing", None, "", "://", "http://xnet/", "http://net/", "http://org?/fr/", "http://u.example.com/de#/", "http://é.org/fr/\n" + "x" * 5000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id int, url string, host string")
    rows = url_filter.judge(pages, URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert got[0] == ("www.example.net", "/en/1", "example.net/en/") and got[1] == ("example.com", "/de/", "example.com/de/")
    assert got[2][2] == "org/fr/" and got[3][2] is None and got[4][2] is None
    assert got[5] == got[6] == got[7] == got[8] == ("", "", None)
    assert got[9][2] is None and got[10] == ("net", "/", "net/") and got[11] == ("org", "", None) and got[12] == ("u.example.com", "/de", None)
    assert got[13][2] == "org/fr/"
    verdicts = {r.page_id: r.verdict for r in rows}
    assert verdicts[0] == "allow" and verdicts[1] == "block" and set(verdicts.values()) <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_a_hot_url_leaves_room_for_others_in_the_sample(spark):
    urls = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://buy-cheap-"), "id", F.lit(".x.test/p?a=1&b=2")))
                                   .otherwise(F.concat(F.lit("http://site"), "id", F.lit(".y.test/about"))).alias("url"))
    hot = urls.orderBy(F.xxhash64("url")).first().url
    unruled = spark.createDataFrame([("http://buy-cheap-1.z.test/p?a=1&b=2",), ("http://site1.z.test/about",)], "url string")
    pages = urls.union(spark.createDataFrame([(hot,)] * 500, "url string")).union(unruled).withColumn("page_id", F.monotonically_increasing_id())
    rows = url_filter.judge(pages, [("block", "x.test/"), ("allow", "y.test/")], sample=300).where("rule is null").collect()
    assert sorted((r.host, r.verdict) for r in rows) == [("buy-cheap-1.z.test", "block"), ("site1.z.test", "allow")]


def test_trees_learn_from_labelled_urls(spark, folder):
    """Spam hosts under a ruled name are blocked; the trees carry that to such hosts without a rule."""
    pages = spark.range(600).selectExpr(
        "id AS page_id", "if(id % 2 = 0, concat('http://buy-cheap-', id, '.x.test/p?a=1&b=', id, '&c=2'), concat('http://site', id % 7, if(id % 4 = 1, '.y.test', '.z.test'), '/about')) AS url")
    pages = pages.withColumn("url", F.when(F.col("page_id") % 10 == 8, F.concat(F.lit("http://buy-cheap-"), "page_id", F.lit(".w.test/p?a=1&b=2&c=3"))).otherwise(F.col("url")))
    rows = url_filter.judge(pages, [("block", "x.test/"), ("allow", "y.test/")]).where("rule is null").collect()
    right = [(r.verdict == "block") == r.host.startswith("buy") for r in rows]
    assert sum(right) / len(right) > 0.95


# ---- mixing

def filled(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    sources = ["b", "a", None, "é", "Z", "tiny", "empty"]
    rows = [(i, " ".join(["w"] * (i * 7 % 90 + 1)), sources[0 if i % 3 == 0 else i % 5], 1) for i in range(4000)]
    rows += [(5000, None, "empty", 1), (5001, "", "empty", 1), (5002, "one two", "tiny", 1), (None, "x y z", "b", 1), (1, rows[1][1], rows[1][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    plan = source_mix.mixed(docs)
    got = plan.select("doc", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = filled(sizes, (3, 1, 2), 1.5, 2)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] + 4
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mixed(docs.repartition(7)).select(*got[0].__fields__).collect()))
    corpus = source_mix.apply_mix(docs, plan)
    assert corpus.columns == docs.columns
    words = {r.source: r.n for r in corpus.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], docs.schema)
    assert sorted((r.doc, r.target, r.taken) for r in source_mix.mixed(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


# ---- sharding

def test_shards(spark):
    rows = [(i, "copy" * 30 if i % 3 == 0 else f"text {i} " * (i % 50), 1) for i in range(6000)]
    rows += [(7000, None, 1), (7001, "", 1), (None, "no id", 1), (5, "twice", 1), (5, "twice", 1), (7002, "ü" * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.shard(docs, 40).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "size", "shard", "slot"] or set(got[0].__fields__) == {"doc_id", "text", "size", "shard", "slot"}
    shards = {}
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(40)) and len(shards) == 40
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    mean = sum(r.size for r in got) / 40
    largest = max(r.size for r in got)
    assert all(abs(sum(r.size for r in own) - mean) <= largest + 0.002 * mean for own in shards.values())
    assert {(r.doc_id, r.text): r.shard for r in got} == {(r.doc_id, r.text): r.shard for r in sharding.shard(docs.repartition(3), 40).collect()}


def test_few_rows_in_many_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id bigint, text string")
    got = sharding.shard(docs, 40).collect()
    assert len(got) == 3 and all(0 <= r.shard < 40 for r in got)
    assert sharding.shard(docs.limit(0), 40).count() == 0
    assert zlib.crc32(b"") == 0


# ---- pipeline

def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from test_text_operators import groups, removed, words

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mix", "sentencepiece"]
    clean = stages["toxicity"](spark, docs, folder)
    scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scored.where("predicted = 0").collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    single = stages["ngram_jaccard_join"](spark, docs, folder)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, c in groups(rows, 5, 80) if i == c)
    short = stages["substring_dedup"](spark, docs, folder)
    assert sorted((r.doc_id, r.text) for r in short.collect()) == sorted((i, t) for i, t, *_ in removed(rows))
    mixed = stages["source_mix"](spark, docs, folder)
    total = sum(len(words(t)) for _, t in rows)
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) < 0.01 * total
    assert all(f.columns == docs.columns for f in (clean, single, short, mixed))
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "token_ids", "n_tokens"] and out.count() > 150


def test_top_k_of_repeated_ids(spark):
    """Rows of one id count once, and a query's own rows never crowd others out."""
    own = [(0, [9.0], 1, "")] * 2 + [(0, [8.5], 1, ""), (0, [8.0], 1, "")] + [(i, [float(i % 7)], 1, "") for i in range(1, 20)]
    found = topk.top_k(spark.createDataFrame(own, VECTORS), "vec_id = 0", k=1, scale=1)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 6, 54)]
    many = [(0, [1.0], 1, "")] + [(5, [9.0 - i / 10], 1, "") for i in range(6)] + [(i, [float(i - 10)], 1, "") for i in range(10, 18)]
    found = topk.top_k(spark.createDataFrame(many, VECTORS), "vec_id = 0", k=3, scale=10)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 5, 900), (0, 2, 17, 700), (0, 3, 16, 600)]


@pytest.mark.parametrize("copies", [1, 4])
def test_bounds_never_lose_a_candidate(copies):
    rng = np.random.RandomState(copies)
    ids = np.sort(rng.randint(0, 600 // copies, 600))
    vectors = rng.randint(-300, 300, (600, 12))
    asked = vectors[:40] + rng.randint(-9, 9, (40, 12))
    query, candidate, score = topk.best(ids, vectors, ids[:40], asked, 7)
    found = sorted(zip(query.tolist(), candidate.tolist(), score.tolist()))
    expected = []
    for q, v in zip(ids[:40], asked):
        scored = {}
        for c, w in zip(ids, vectors @ v):
            if c != q:
                scored[int(c)] = max(int(w), scored.get(int(c), -10**9))
        expected += [(int(q), c, s) for c, s in sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:7]]
    assert found == sorted(expected)
