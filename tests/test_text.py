import pytest
from pyspark.sql import functions as F

from sentinel.functions import fixed_values as fv
from sentinel.functions import text
from sentinel.functions.index_names import index_family, index_may_match, index_matches


@pytest.fixture
def apply(spark):
    def run(expression, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x STRING")
        out = rows.select("i", F.expr(expression("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]

    return run


def test_fingerprint_groups_alike_messages(apply):
    a, b, c, d, e, f = apply(
        text.fingerprint, "timeout after 30s", "timeout after 45s",
        "user 550e8400-e29b-41d4-a716-446655440000 failed",
        "user 11111111-2222-3333-4444-555555555555 failed",
        "file 'a.txt' not found", 'file "b.log" not found')
    assert a == b == "timeout after <n>s"
    assert c == d == "user <id> failed"
    assert e == f == "file <str> not found"
    assert apply(text.fingerprint, "database down", "cache down") == ["database down", "cache down"]


def test_fingerprint_quirks(apply):
    assert apply(text.fingerprint, "n 12345678", "n 1234567", "it's Bob's", " a\t\nb ", "ü12 ٣") == [
        "n <hex>", "n <n>", "it<str>s", "a b", "ü<n> <n>"]


def test_scrub(apply):
    out = apply(
        text.scrub,
        "login user@example.com from 10.24.12.12 token=ABCDEFGHIJKLMNOPQRSTUVWXYZ012345",
        "Authorization: Bearer abc.def-ghi123",
        "token eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9 rest",
        "mysql://admin:s3cretPass@db:3306/x",
        "database connection refused",
        "client 2001:0db8:85a3:0000:0000:8a2e:0370:7334 blocked",
        "from ::1", "link-local fe80::1%eth0", "peer 2a02:8109::42:1 timed out",
        "2026-06-01T12:34:56.000Z ok", "mac aa:bb:cc:dd:ee:ff", "", None)
    assert out == [
        "login <email> from <ip> token=<token>", "Authorization: bearer <token>",
        "token <jwt> rest", "mysql://admin:<pw>@db:3306/x", "database connection refused",
        "client <ip> blocked", "from <ip>", "link-local <ip>", "peer <ip> timed out",
        "2026-06-01T12:34:56.000Z ok", "mac aa:bb:cc:dd:ee:ff", "", None]


def test_mask_keeps_names_and_addresses(apply):
    assert apply(
        text.mask_counters, "30 Fehler (4, Faktor 3.0).", "Host vm-01: 5", "Index 'logs-2': 0",
        "IP 45.9.1.2: 300 4xx", "IP 2001:db8::42: 7 x") == [
        "<n> Fehler (<n>, Faktor 3.0).", "Host vm-01: <n>", "Index 'logs-2': <n>",
        "IP 45.9.1.2: <n> 4xx", "IP 2001:db8::42: <n> x"]


def test_phrases_are_whole_consecutive_words(apply):
    def disk(x):
        return text.has_phrase(text.words(x), fv.DISK_PHRASES)

    assert apply(disk, "XFS (sdb1): metadata I/O error", "Starting Online XFS Metadata Check",
                 "EXT4-fs error (device sda1)", "radio/error", "critical MEDIUM error, dev sda") == [
        True, False, True, False, True]


def test_path_tokens(apply):
    def probe(x):
        return text.contains_any(x, fv.PATH_TOKENS)

    assert apply(probe, "/WP-Login.php", "/api/items", "/a/../etc/passwd", "/x?q=union+select",
                 "/phpMyAdmin/", "/config") == [True, False, True, True, True, False]
    # leaving out fragments that contain shorter ones changes nothing
    assert len([t for t in fv.PATH_TOKENS]) == 60


@pytest.mark.parametrize("name,family", [
    ("shop-logs-2026.06", "shop-logs"), ("shop-logs-2026.06.30", "shop-logs"),
    (".ds-web-logs-default-2026.06.01-000012", "web-logs-default"), ("plain", "plain"),
    (".ds-web-logs-default-2026.06.01-12", ".ds-web-logs-default-2026.06.01-12"),
])
def test_index_family(apply, name, family):
    assert apply(index_family, name) == [family]


def test_index_patterns(apply):
    names = ["app-logs-2026.06", ".ds-app-logs-x-2026.06.01-000001", "other", ".hidden", "app-test"]
    for patterns, expected in [
        (["app-*"], [True, True, False, False, True]),
        (["app-*", "-app-test"], [True, True, False, False, False]),
        (["app-logs-2026.06,other"], [True, False, True, False, False]),
        ([".hid*"], [False, False, False, True, False]),
        (["missing-*"], [False] * 5),
    ]:
        exact = apply(lambda x: index_matches(patterns, x), *names)
        assert exact == expected
        rough = apply(lambda x: index_may_match(patterns, x), *names)
        assert all(r for r, e in zip(rough, exact) if e), "the cheap test may not lose rows"
