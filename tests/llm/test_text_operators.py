"""Substring dedup, n-gram join, pieces, chat and toxicity against brute force on literal and small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentinel.llm import blocks, chat, ngram_join, pieces, toxicity
from sentinel.llm import words as word_steps
from sentinel.llm.ngram_join import jaccard_groups
from sentinel.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, n_words string, bucket int"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_texts():
    rng = random.Random(3)
    base = [rng.choice(["alpha", "béta", "γ", "d", "E"]) + str(rng.randrange(300)) for _ in range(400)]
    texts = [None, "", " \t\n", "one", "One", "one two", " ".join(base), " ".join(base), " ".join(base[50:120]),
             " ".join(base[:5]), "a " * 5000, "x" * 100_000, " ".join(base[:200]) + " NEW " + " ".join(base[200:])]
    for i in range(40):
        edited = list(base)
        for _ in range(i):
            edited[rng.randrange(len(edited))] = "edit" + str(rng.randrange(10**6))
        texts.append(("\n" if i % 2 else " ").join(edited))
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(odd_texts())]
    rows += [(6, rows[6][1], "clash", 1), (7, "one id and another text " * 8, "clash", 1), (None, rows[6][1], "clash", 1)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


# ---- substring dedup

def removed(rows, width=13):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            w = words(text)
            for k in range(len(w) - width + 1):
                key = tuple(w[k:k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        kept = text
        if any(gone):
            parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
            kept = re.match(r"[\x20\x09-\x0D]*", text)[0] + "".join(x for x, g in zip(parts, gone) if not g)
        out.append((i, kept, len(w), sum(gone), 1))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(odd):
    rows, docs = odd
    found = remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "bucket", "n_words", "n_removed"]
    got = [(r.doc_id, r.text, r.n_words, r.n_removed, r.bucket) for r in found.collect()]
    assert sorted(got, key=str) == removed(rows)
    assert sum(r[3] for r in got) > 5000


def test_substring_dedup_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(5, "a b", "", 1)] * 3, DOCS)
    assert [(r.n_words, r.n_removed) for r in remove_repeats(same).collect()] == [(2, 0)] * 3


# ---- n-gram join

def groups(rows, width, num):
    sets = {}
    for i, text, *_ in rows:
        w = words(lowered(text))
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        if i is not None:
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(odd, width, num):
    rows, docs = odd
    found = ngram_join.jaccard_groups(docs, width, num).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None)
    assert got == groups(rows, width, num)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert any(i != c for i, _, c in got)


def test_large_clusters_are_compared_in_parts(odd, monkeypatch):
    rows, docs = odd
    monkeypatch.setattr(ngram_join, "CELL_FEATURES", 2000)
    found = ngram_join.jaccard_groups(docs, 3, 90).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == groups(rows, 3, 90)


def near_copies(n, length=60):
    """Texts of one passage, each with one word of its own at the end."""
    passage = " ".join(f"w{i}" for i in range(length))
    return [f"{passage} own{k}" for k in range(n)]


def joined(spark, rows, width=3, num=90):
    """Groups of rows that come to one task in this order, a batch each."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        return sorted(map(tuple, ngram_join.jaccard_groups(docs, width, num).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ngram_join_of_copies_met_in_descending_order(spark):
    near, other = near_copies(2)
    rows = [(900, near), (500, other), (12, near), (7, other)]
    assert joined(spark, rows) == groups(rows, 3, 90) == [(i, 59, 7) for i in (7, 12, 500, 900)]


def test_ngram_join_of_an_id_with_a_copy_and_another_text(spark):
    near, other = near_copies(2)
    rows = [(1, "a text that only two rows have"), (5, "a text that only two rows have"), (5, near), (3, other)]
    assert joined(spark, rows) == groups(rows, 3, 90)
    assert {c for _, _, c in joined(spark, rows)} == {1}


def test_many_short_sets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_SETS", 16)
    cluster = spark.range(400).selectExpr("id AS node", "0L AS component")
    sets = spark.range(400).selectExpr("id AS doc", "40L AS n", "id AS f1", "id AS f2")
    placed = ngram_join._cells(cluster, sets, 90, 100, 800_000).select(F.explode("cells").alias("cell"), "doc").collect()
    cells = {}
    for r in placed:
        cells.setdefault(r.cell, set()).add(r.doc)
    assert max(map(len, cells.values())) < 80
    met = {(a, b) for own in cells.values() for a in own for b in own if a < b}
    assert len(met) == 400 * 399 // 2


def test_a_large_signature_group_is_written_once(monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    docs = np.arange(100, dtype=np.int64)
    rows = list(blocks.pack(np.full(100, 77, np.uint64), np.arange(100), np.zeros(100, np.int64), [docs], 1, ngram_join.SIGNATURE_BYTES))
    empty = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary())] * 2
    table = pa.table([*blocks.batch_of(rows).columns, *empty], names=ngram_join._FOUND_NAMES)
    found = ngram_join._meet(table).select(["part", "parts", "members"]).to_pylist()
    assert sorted(x for row in found for x in row["members"]) == list(range(100))
    assert [(r["part"], r["parts"]) for r in found] == [(i, 25) for i in range(25)]


def test_blocks_of_a_product_find_the_same_links(monkeypatch):
    rng = np.random.RandomState(5)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 57, replace=False), np.uint64(1000 + i))) for i in range(50)]
    found = ngram_join.linked(np.arange(50), sets, 90, 100)
    parent = {x: y for x, y in found}
    near = {(a, b) for a in range(50) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert near and all(parent.get(a, a) == parent.get(b, b) for a, b in near)
    monkeypatch.setattr(ngram_join, "BLOCK", 350)
    assert ngram_join.linked(np.arange(50), sets, 90, 100) == found


@pytest.mark.parametrize("num", [90, 80])
def test_similar_sets_share_a_signature(num):
    rng = np.random.RandomState(num)
    for n in [*range(1, 40), 75, 130, 300, 900]:
        for _ in range(12):
            common = rng.randint(0, 2**62, n).astype(np.uint64)
            spare = rng.randint(0, 2**62, 2 * n).astype(np.uint64)
            a_only, b_only = (rng.randint(0, max(1, n * (100 - num) // num) + 1) for _ in range(2))
            if 100 * n < num * (n + a_only + b_only):
                continue
            a = np.unique(np.concatenate([common, spare[:a_only]]))
            b = np.unique(np.concatenate([common, spare[n:n + b_only]]))
            sigs, row = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
            assert set(sigs[row == 0]) & set(sigs[row == 1]), (n, a_only, b_only)


def test_ngram_join_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_groups(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "", 1), (2, "", "", 1), (None, None, "", 1)], DOCS)
    assert sorted(map(tuple, ngram_join.jaccard_groups(blank).collect()), key=str) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
    kept = ngram_join.keep_first(blank.union(blank), ngram_join.jaccard_groups(blank.union(blank)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2]


# ---- pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def plain_viterbi(vocabulary, word):
    unknown = min(s for _, s in vocabulary.pieces.values()) - pieces.BYTES_PENALTY
    best = [(0.0, [])] + [(-1e18, [])] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 20), end):
            piece = word[start:end]
            if pieces.MARK in piece[1:] or (start and piece == pieces.MARK) or (start and piece[0] == pieces.MARK):
                continue
            if piece in vocabulary.pieces:
                i, s = vocabulary.pieces[piece]
                if best[start][0] + s > best[end][0]:
                    best[end] = best[start][0] + s, best[start][1] + [i]
        if best[end - 1][0] + unknown > best[end][0]:
            best[end] = best[end - 1][0] + unknown, best[end - 1][1] + [vocabulary.bytes[b] for b in word[end - 1].encode()]
    return best[-1]


def test_shared_prefixes_change_no_encoding(spark, folder, vocabulary):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(40).collect()]
    marked = sorted({pieces.MARK + w for t in texts for w in t.split(" ")} | {"▁a▁b", "▁日本\U0001F600", "▁" + "ab" * 300})[:4000]
    scores = {i: s for i, s in vocabulary.pieces.values()}
    for word, ids in pieces.Encoder(vocabulary).encode_all(marked):
        score, path = plain_viterbi(vocabulary, word)
        if list(ids) != path:
            assert sum(scores.get(i, 0) for i in ids) == pytest.approx(sum(scores.get(i, 0) for i in path))


def test_pieces_round_trip(spark, vocabulary):
    texts = [None, "", " ", "  two  spaces ", "line\nfeed\ttab", "▁mark ▁▁", "<0x41> <s> </s>", "日本 \U0001F600 é", "y" * 30_000,
             "same", "same"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, token_ids string")
    tokens = pieces.encode(docs, vocabulary)
    back = pieces.decode(tokens.drop("text"), vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
    assert [len(r.token_ids) for r in sorted(back, key=lambda r: r.doc_id)[1:2]] == [0]
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


# ---- chat

@pytest.mark.parametrize("text", ["", "plain", "### User:\nhi\n</turn>\n", "\\### Assistant: </turn> ok", "ends with \\", "</turn>",
                                  "\n</turn>\n", "\\\\</turn>", "a\\\\\\### b", "###  ", "\n", "</tur</turn>n>"])
@pytest.mark.parametrize("role", ["user", "", "odd: role", "a\nb", "x\\", "### y", "</turn>", "\\:"])
def test_turns_read_back(role, text):
    out = chat.format_turn(role, text)
    assert [(r, t) for r, t, _ in chat.parse(out + chat.format_turn("user", "next"))] == [(role, text), ("user", "next")]


def test_free_control_strings_are_refused():
    for bad in ("hello", "### user:\nhi\n", "### user:\na ### b\n</turn>\n"):
        with pytest.raises(chat.ParseError):
            list(chat.parse(bad))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "a"), (1, 1, "assistant", "B"), (2, None, None, None), (None, 0, "assistant", "z" * 50_000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    one = found[1]
    assert (one.n_turns, one.loss_chars) == (3, 2)
    assert one.turns_sha256 == hashlib.sha256(b"user\na\nassistant\nB\nassistant\nB\n").hexdigest()
    assert one.loss_sha256 == hashlib.sha256(b"BB").hexdigest()
    assert (found[2].n_turns, found[2].turns_sha256) == (1, hashlib.sha256(b"\n\n").hexdigest())
    assert found[None].loss_chars == 50_000
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# ---- toxicity

def test_clauses_decide():
    accept = toxicity.Acceptor({w + "$": toxicity.SEED_WEIGHT for w in toxicity.INSULTS})
    weigh = lambda text: toxicity.measures(text, accept)[0]
    assert weigh("you are an idiot") > weigh("an idiot stood there") > weigh("he is not an idiot") > 0
    assert weigh("the idiot") > weigh("they wrote that the idiot")
    assert weigh("I will kill you") > 0 == weigh("I will kill the lights")
    assert weigh("idiots") == weigh("") == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    hit = scored.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r.toxic: r.p for r in hit}
    assert rate[1] > 0.9 and rate[0] < 0.03


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "you pathetic idiot", 3.0), (None, "fine", 3.0)], "doc_id int, text string, score double")
    labels = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert [rows[i].predicted for i in (1, 2, 3, None)] == [0, 0, 1, 0]
    assert rows[1].score == rows[2].score and all(0 <= r.score <= 1 for r in rows.values())
    assert toxicity.score(docs.limit(0), toxicity.Grammar({}, toxicity.UNTAUGHT)).count() == 0


def test_rolling_hashes_are_polynomials_modulo_the_prime():
    rng = np.random.RandomState(1)
    values = rng.randint(0, 2**63 - 1, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for width in (1, 3, 13):
        expected = []
        for j in range(500 - width + 1):
            x = sum(int(values[j + i]) * pow(word_steps.BASE, i, word_steps.PRIME) for i in range(width)) % word_steps.PRIME
            expected.append(x)
        assert (word_steps.rolling(values, width) == word_steps.mix(np.array(expected, np.uint64))).all()


def test_words_of_mirrored_letters_are_told_apart(spark):
    """Thue-Morse words: a polynomial modulo 2**64 can't tell a word from its mirror."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    hashes = word_steps.words_of(pa.array([one, two])).hashes
    assert hashes[0] != hashes[1]
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in remove_repeats(docs).collect()) == [(*r, 0) for r in rows]
    alone = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert sorted(r.component_id for r in jaccard_groups(alone).collect()) == [1, 2]


def test_untouched_texts_keep_their_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"def f():\n    return 1\n\n\tx {passage}"), (2, "def f():\n    return 1\n\n\tx"), (3, f"a\n\n  b {passage} c\t\td \n"),
            (4, "  \n "), (5, passage.replace(" ", "\n"))]
    kept = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1: (rows[0][1], 25, 0), 2: (rows[1][1], 5, 0), 3: ("a\n\n  b c\t\td \n", 24, 20), 4: ("  \n ", 0, 0), 5: ("", 20, 20)}


@pytest.mark.parametrize("num", [80, 90])
def test_sketches_rule_out_no_similar_pair_and_most_others(num):
    rng = np.random.RandomState(num)
    kept = np.zeros(2)
    for n in [1, 2, 7, 40, 260, 1000, 3000]:
        for share in (num, num, num, 40, 60):
            common = int(np.ceil(2 * n * share / (100 + share)))
            a, b = (np.unique(rng.randint(0, 2**62, n).astype(np.uint64)) for _ in range(2))
            b = np.unique(np.concatenate([a[:common], b[common:]]))
            similar = 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))
            short, whole = ngram_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            whole = [w or s for w, s in zip(whole, short)]
            sizes = np.array([len(a), len(b)])
            found = [bool(ngram_join.possible(np.arange(2), sizes, raw, num, 100)) for raw in (short, whole)]
            assert not similar or found == [True, True]
            if share == 40 and n > 200:
                kept += [1, found[1]]
    assert kept[0] and kept[1] == 0


def test_long_texts_that_share_passages_are_judged_exactly(spark):
    """Texts of thousands of words with common passages: many candidates, few links."""
    rng = random.Random(11)
    passages = [" ".join(f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(60):
        text = " ".join([*rng.sample(passages, 3 + i % 5), *(f"own{rng.randrange(10**7)}" for _ in range(rng.choice([20, 200, 900])))])
        rows.append((i, text, "", 1))
        if i % 6 == 0:
            own = text.split()
            for at in rng.sample(range(len(own)), len(own) // rng.choice([40, 60, 200])):
                own[at] = "changed"
            rows.append((1000 + i, " ".join(own), "", 1))
    for width, num in ((5, 80), (3, 90)):
        found = ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(4), width, num).collect()
        expected = groups(rows, width, num)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
        assert any(i != c for i, _, c in expected)


def test_chance_is_exact_where_it_is_summed():
    assert toxicity._chance(2, 2, 0.5) == 0.25 and toxicity._chance(1, 10, 0.2) == 1.0
    assert abs(toxicity._chance(7, 8, 0.28) - (8 * 0.28 ** 7 * 0.72 + 0.28 ** 8)) < 1e-12
    whole = sum(math.comb(300, i) * 0.1 ** i * 0.9 ** (300 - i) for i in range(60, 301))
    assert whole <= toxicity._chance(60, 300, 0.1) < 50 * whole


def test_toxicity_of_very_long_and_repeated_texts(spark):
    grammar = toxicity.Grammar({"idiot$": 3.0}, toxicity.UNTAUGHT)
    calm, last = "all is well. " * 200_000, "all is well. " * 200_000 + "you are an idiot!"
    rows = [(1, calm, "clash"), (2, last, "clash"), (3, "you idiot", "clash"), (3, "you idiot", "clash"), (None, "you idiot", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    found = [(r.doc_id, r.score) for r in toxicity.score(docs, grammar).collect()]
    by = dict(found)
    assert len(found) == 5 and by[2] > by[1] and by[3] == by[None] > 0.5  # the end of a long text counts
    assert [s for i, s in found if i == 3] == [by[3]] * 2
