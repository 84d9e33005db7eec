"""Prefix trie, source divergence and fingerprints against brute force, on rows with edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.llm import divergence as audit
from sentinel.llm.fingerprint import differing, fingerprint, likeness, with_next
from sentinel.llm.prefix_trie import DoubleArray, end_digests, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, node string, words string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def trie_of(rows, every, most):
    """All node columns, by dicts over tuples."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1) if most else 0
        donor = c - int(np.fmod(c, every))
        full = own[c] if donor == c else own.get(donor, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, d == len(full)))
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for path, own_members in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(str(c) for c in sorted(c for c, last in own_members if last))
        out.append((min(c for c, _ in own_members), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(own_members), kids[path],
                    sum(not kids[p] for p in below), sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(0, 47), -3, -41]:
        same = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            text = f"Hallo Welt {turn}" if same and rng.random() < 0.9 else rng.choice(["", None, "a  b\tc", f"x{rng.randrange(4)}", "żółć 漢字"])
            rows.append((conv, turn, rng.choice(["user", "user", None]), text, "clash", "clash"))
    rows += [(500 + i, t, "user", f"copy {t}", "", "") for i in range(40) for t in range(4)]  # one hot conversation
    rows += [(61, None, "user", "null turn", "", ""), (61, 1, "user", "b", "", ""), (61, 1, "user", "b", "", ""), (61, 1, "user", "a", "", "")]
    rows += [(None, 0, "user", "nobody", "", ""), (80, 0, "user", "long " * 50_000, "", "")]
    rows += [(900, t, "user", "on", "", "") for t in range(70)]  # a long one
    return rows


@pytest.mark.parametrize("segment,shard", [(32, 100_000), (3, 25), (1, 1)])
def test_trie_equals_brute_force(spark, segment, shard):
    rows = conversations(segment)
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    nodes, ends = prefix_trie(frame, "conv_id - conv_id % 20", "crc32(cast(cast(conv_id AS string) AS binary)) % 4", 3, segment, shard)
    digests = end_digests(ends).withColumnRenamed("node", "end")
    found = nodes.join(digests, nodes.node == digests.end, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    assert sorted(map(tuple, found.collect()), key=str) == trie_of(rows, 20, 3)


def test_trie_without_donors_and_without_rows(spark):
    rows = conversations(8)
    frame = spark.createDataFrame(rows, TURNS)
    nodes, _ = prefix_trie(frame)
    mine = [x[:7] for x in trie_of(rows, 1, 0)]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    assert sorted((tuple(r) for r in nodes.select(columns).collect()), key=str) == sorted(mine, key=str)
    nodes, ends = prefix_trie(frame.limit(0))
    assert nodes.count() == 0 and end_digests(ends).count() == 0


@pytest.mark.parametrize("kinds", [2, 50, 5000])
def test_double_array_finds_exactly_what_was_packed(kinds):
    rng = np.random.RandomState(kinds)
    paths = sorted({tuple(rng.randint(1, kinds, rng.randint(1, 7)).tolist()) for _ in range(3000)})
    sizes = np.array([len(p) for p in paths])
    codes = np.zeros((len(paths), 6), np.int64)
    for r, p in enumerate(paths):
        codes[r, : len(p)] = p
    trie = DoubleArray(codes, sizes)
    prefixes = {p[:d]: 0 for p in paths for d in range(1, len(p) + 1)}
    for prefix in prefixes:
        state = np.zeros(1, np.int64)
        for code in prefix:
            state = trie.step(state, np.array([code]))
        prefixes[prefix] = int(state[0])
    assert len(set(prefixes.values())) == len(prefixes) == int((trie.check >= 0).sum()) - 1
    # what is not there is not found
    for prefix, state in list(prefixes.items())[:300]:
        for code in range(1, min(kinds, 40)):
            there = prefix + (code,) in prefixes
            slot = trie.base[state] + code
            assert (0 <= slot < len(trie.check) and trie.check[slot] == state) == there


def divergence_of(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in spread.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        all_of = sum(counts.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        for s, c in counts.items():
            pairs = [(-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), other.encode(), other) for other, o in counts.items() if other != s]
            far = [(-((share(c, t) - share(all_of, t)) ** 2 // share(all_of, t)), t.encode(), t) for t in c if share(c, t) > share(all_of, t)]
            out += [(lang, s, "pair", i, -v, n + 1) for n, (v, _, i) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", i, -v, n + 1) for n, (v, _, i) in enumerate(sorted(far)) if n < top]
    return sorted(out)


DOCS = "doc_id bigint, text string, lang string, source string, term string, n int, part string"


def documents(seed, n=160, vocabulary=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"W{''.join(chr(97 + int(x)) for x in str(int(rng.paretovariate(0.6)) % vocabulary))}" for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "B", "", None, "ü"]), "x", 1, "y"))
    rows += [(1000, None, "en", "only null"), (1001, "12 34 !?", "xx", "p"), (1002, "once", "xx", "q"), (1003, "Été été-ÉTÉ naïve", "fr", "s"),
             (1004, "été", "fr", "s"), (1005, "été", "fr", "s"), (1006, "été", "fr", "t"), (1007, "word " * 100_000, "en", "long"), (None, "Wb Wc", "en", "a")]
    return [(*r, "x", 1, "y")[:7] for r in rows]


@pytest.mark.parametrize("part", [100_000, 40])
def test_divergence_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(audit, "PART_ROWS", part)
    rows = documents(part)
    found = audit.divergence(spark.createDataFrame(rows, DOCS).repartition(5))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == divergence_of(rows)
    few = audit.divergence(spark.createDataFrame(rows, DOCS), least_docs=1, top=2)
    assert sorted(map(tuple, few.collect())) == divergence_of(rows, 1, 2)
    assert audit.divergence(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("at_once", [4_000_000, 50])
def test_cells_equal_sums_over_terms(monkeypatch, at_once):
    monkeypatch.setattr(audit, "CELLS", at_once)
    rng = np.random.RandomState(at_once)
    terms, groups = 301, 6
    counts = (rng.zipf(1.3, (groups, terms)) % 40) * (rng.rand(groups, terms) < 0.4)
    counts[4] = 0
    p = 1 + 10**9 * (counts + 1) // (counts.sum(axis=1, keepdims=True) + terms)
    group, term = np.nonzero(counts)
    none = 1 + 10**9 // (counts.sum(axis=1) + terms)
    found = audit.cells(term, group, counts[group, term], terms, groups, p[group, term], none)
    assert (found == ((p[:, None] - p[None]) ** 2 // p[None]).sum(axis=2)).all()


def test_shares_of_huge_counts():
    counts = np.array([0, 10**10, 5])
    assert audit._shares(counts, np.full(3, 10**12), np.full(3, 7)).tolist() == [1 + 10**9 * (int(c) + 1) // (10**12 + 7) for c in counts]


TEXTS = "doc_id bigint, text string, key string, fp string, next string"


def test_next_documents_and_trees(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc ,.é漢😀") for _ in range(rng.randrange(200))) for _ in range(400)]
    rows = [(i * 7 % 101, "\n".join(lines[i: i + 1 + i % 9]), "k", "f", "n") for i in range(90)]
    rows += [(500, None, "", "", ""), (501, "", "", "", ""), (502, "x" * 300_000, "", "", ""), (503, "\n\n", "", "", ""), (504, "line\n" * 20_000, "", "", "")]
    rows += [(600, "same", "", "", "")] * 30 + [(600, "other", "", "", ""), (None, "no id", "", "", "")]
    frame = spark.createDataFrame(rows, TEXTS).repartition(7)
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0),
                      hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
    after = {d: distinct[(i + 1) % len(distinct)] for i, d in enumerate(distinct)}
    found = with_next(frame).collect()
    assert len(found) == len(rows)
    prints = {r.text: r.fingerprint for r in found}
    assert len(set(prints.values())) == len(prints)
    for r in found:
        following = after[(r.doc_id, r.text)]
        assert r.next_start == following[1][: len(r.text) // 3] and r.next_fingerprint == prints[following[1]]
        # the root is the digest of the text's pieces, level by level
        sections, run = [], ""
        for line in re.findall(r"[^\n]*\n|[^\n]+", r.text):
            whole = [hashlib.sha256(p.encode()).hexdigest() for p in re.findall(r"(?s).{1,80}?[.!?;:,\n] ?|.{1,80}", line)]
            assert "".join(re.findall(r"(?s).{1,80}?[.!?;:,\n] ?|.{1,80}", line)) == line
            digest = hashlib.sha256("".join(whole).encode()).hexdigest()
            run += digest + ";"
            if digest.endswith("0"):
                sections, run = [*sections, run], ""
        sections += [run] if run else []
        top = "".join(hashlib.sha256(s.encode()).hexdigest() for s in sections)
        assert r.fingerprint.startswith(hashlib.sha256(top.encode()).hexdigest()) and r.fingerprint.count("#") == len(sections)
    assert with_next(frame.limit(0)).count() == 0
    one = with_next(spark.createDataFrame([(1, "abcdef", "", "", "")], TEXTS)).first()
    assert one.next_start == "ab" and one.next_fingerprint == one.fingerprint


def test_edits_are_located_and_likeness_follows_them(spark):
    lines = [f"Line number {i}, with a clause; and one more." for i in range(200)]
    edited = [*lines[:120], "Something else.", *lines[121:]]
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(edited)), ("", ""), ("", "a"), (None, "")], "a string, b string")
    prints = frame.select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    rows = prints.select(likeness(F.col("a"), F.col("b")).alias("like"), differing(F.col("b"), F.col("a")).alias("at"), "b").collect()
    assert 0.98 < rows[0].like < 1 and [r.like for r in rows[1:]] == [1.0, 0.0, 1.0]
    section, paragraph = rows[0]["at"][0]
    assert len(rows[0]["at"]) == 1 and [list(x) for x in rows[2]["at"]] == [[0, 0]]
    before = [s.split("=")[1].count(";") for s in rows[0].b[64:].split("#")[1:]][:section]
    assert sum(before) + paragraph == 120
