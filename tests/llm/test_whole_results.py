"""Whole results of op3, op6, op7 and the pipeline against plain Python, every row and output column."""

import math
import re
import zlib
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from test_table_operators import filled
from test_text_operators import groups, removed, words

import corpus_pipeline as pipeline
from sentinel.llm import pieces, sharding, source_mix, toxicity
from sentinel.llm.queries import QUERIES, SHARDS, URL_RULES


def source_order(source):
    return source is None, (source or "").encode()


def planned(spark, rows, weights=(3, 1, 2), share=1.5, most=2):
    """[(doc, size, source_size, target, words of each pass)] of (doc_id, source, text) rows: slot by slot.

    Only the hashes that shuffle documents come from Spark.
    """
    frame = spark.createDataFrame(rows, "doc bigint, source string, text string")
    hashed = [tuple(r) for r in frame.select("doc", "source", "text", F.xxhash64("doc", F.lit(17)), F.xxhash64("text")).collect()]
    sizes, own = {}, {}
    for doc, source, text, h, mark in hashed:
        sizes[source] = sizes.get(source, 0) + len(words(text))
        own.setdefault(source, []).append((h, doc, len(words(text)), mark, text))
    wanted = filled(sizes, weights, share, most)
    total = sum(sizes.values())
    block = max(1, min(source_mix.BLOCK, total // source_mix.BLOCKS))
    order = sorted(sizes, key=source_order)
    ends = [math.floor(e / sum(wanted.values()) * source_mix.CIRCLE + 0.5) for e in accumulate(wanted[s] for s in order)]
    slots = dict.fromkeys(order, 0)
    for t in range(round(share * total / block)):
        point = t * source_mix.STEP % source_mix.CIRCLE
        slots[next(s for s, end in zip(order, ends) if point < end)] += 1
    out = []
    for source, docs in own.items():
        blocks = math.ceil(sizes[source] / block)
        begin = 0
        for h, doc, size, mark, text in sorted(docs):
            passes = []
            for p in range(most):
                # in pass p the source's blocks 0 to `got` - 1 are taken
                got = min(blocks, max(0, slots[source] - p * blocks))
                passes.append(max(0, min(size, got * block - begin)))
            out.append((doc, size, sizes[source], wanted[source], passes, text))
            begin += size
    return out


def test_mix_slot_by_slot(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    expected = {doc: (size, source_size, pytest.approx(target), sum(passes)) for doc, size, source_size, target, passes, _ in planned(spark, rows)}
    found = QUERIES["op6_source_mix"](spark, folder).collect()
    assert len(found) == len(rows) == len(expected)
    for r in found:
        assert (r["size"], r.source_size, r.target, r.taken) == expected[r.doc_id]


def test_shards_cut_where_bytes_are_nearest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    keyed = docs.select("doc_id", "text", sharding.sort_key(F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    rows = sorted((r.key, r.doc_id, r.text or "") for r in keyed.collect())
    found = {r.doc_id: r for r in QUERIES["op7_sharding"](spark, folder).collect()}
    assert len(found) == len(rows)
    own, below = {}, [0]
    for key, doc, text in rows:
        r = found[doc]
        data = text.encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        own.setdefault(r["shard"], []).append((r.slot, r["size"]))
        below.append(below[-1] + len(data) + 16)
    # shards follow one another along the keys
    assert [found[doc]["shard"] for _, doc, _ in rows] == sorted(found[doc]["shard"] for _, doc, _ in rows)
    assert all(sorted(slot for slot, _ in held) == list(range(len(held))) for held in own.values())
    cuts = list(accumulate(sum(size for _, size in own.get(i, [])) for i in range(SHARDS - 1)))
    possible = [b for b, (left, right) in zip(below[1:], zip(rows, rows[1:])) if left[0] != right[0]]
    for i, cut in enumerate(cuts, 1):
        wanted = below[-1] * i / SHARDS
        best = min(abs(p - wanted) for p in possible)
        assert abs(cut - wanted) <= max(best, sharding.TOLERANCE * below[-1] / SHARDS) + 1e-6


def judged(url):
    """Host, path, rule and the rule's verdict of a URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(rule), rule, verdict) for verdict, rule in URL_RULES
            if ("." + host).endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/"):])]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_every_page_is_judged(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op3_url_filters"](spark, folder).collect()
    assert sorted(r.page_id for r in found) == sorted(urls)
    for r in found:
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, QUERIES["op3_url_filters"](spark, folder).collect()), key=str)


def test_the_whole_pipeline_by_plain_python(spark):
    """Stage after stage on what the one before it left, down to every text and its count."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert {r.predicted for r in scored} == {0, 1}
    sources = {r.doc_id: r.source for r in scored}
    clean = [(r.doc_id, r.text) for r in scored if r.predicted == 0]
    first = {i for i, _, component in groups(clean, 5, 80) if i == component}
    left = [(i, text) for i, text, *_ in removed([row for row in clean if row[0] in first])]
    expected = []
    for doc, size, _, _, passes, text in planned(spark, [(i, sources[i], text) for i, text in left]):
        expected += [(doc, sources[doc], text if n == size else " ".join(words(text)[:n])) for n in passes if n]
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "token_ids", "n_tokens"]
    vocabulary = pieces.Vocabulary.load()
    texts = pieces.decode(out, vocabulary).collect()
    assert sorted((r.doc_id, r.source, r.text) for r in texts) == sorted(expected)
    assert all(r.n_tokens == len(r.token_ids) for r in texts)
