"""Field names per target: configuration, paths into structs and maps, several sets of names over one table."""

import pytest
from pyspark.sql import types as T

from sentinel.config import Span, Target, targets_from
from sentinel.operators import incidents
from sentinel.plans.watch import Fleet, Watch
from sentinel.sources.logs import LOG_SCHEMA, conform, field_of

SPAN = Span.replay("2026-06-01T00:00:00Z", "2026-06-01T12:00:00Z")


def test_field_settings_of_one_target_do_not_reach_another():
    plain, edge = targets_from({
        "defaults": {"message_field": "text.keyword"},
        "targets": [{"name": "plain"}, {"name": "edge", "security_ip_field": "labels.Client", "message_field": "line",
                                        "linux_message_field": "raw", "timestamp_field": "@timestamp"}]})
    assert plain.field_names == {"message_template": "text.keyword"}
    assert edge.field_names == {"message_template": "line", "source_ip": "labels.Client", "host_message": "raw", "ts": "@timestamp"}
    assert Target().field_names == {}


def test_paths():
    inner = T.StructType([T.StructField("status_code", T.LongType()), T.StructField("odd`name", T.StringType())])
    schema = T.StructType([
        T.StructField("level", T.StringType()), T.StructField("a.b", T.StringType()),
        T.StructField("a", T.StructType([T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])),
        T.StructField("http", T.StructType([T.StructField("response", inner)])),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("numbers", T.MapType(T.IntegerType(), T.StringType()))])
    for name, path in {"level": "`level`", "level.keyword": "`level`", "a.b": "`a.b`", "a.c": "`a`.`c`",
                       "http.response.status_code": "`http`.`response`.`status_code`", "http.response.odd`name": "`http`.`response`.`odd``name`",
                       "labels.Ip.Address": "`labels`['Ip.Address']", "labels.it's": "`labels`['it\\'s']",
                       "numbers.1": None, "http.request": None, "level.x": None, "none.keyword": None}.items():
        assert field_of(schema, name) == path, name


def test_conform_reads_paths_and_refuses_what_it_cannot(spark):
    source = spark.sql("SELECT timestamp_ntz'2026-06-01 01:00:00' AS `@timestamp`, 'x' AS index_name,"
                       " named_struct('response', named_struct('status_code', '404')) AS http, map('IpAddress', '1.2.3.4') AS labels, 7 AS other")
    out = conform(source, {"ts": "@timestamp", "status_code": "http.response.status_code", "source_ip": "labels.IpAddress", "level": "nowhere"})
    row = out.collect()[0]
    assert out.columns == [f.name for f in LOG_SCHEMA.fields]
    assert (row.status_code, row.source_ip, row.level, row.labels) == (404, "1.2.3.4", None, {"IpAddress": "1.2.3.4"})
    with pytest.raises(ValueError, match="clock"):
        conform(source)
    with pytest.raises(ValueError, match="severity"):
        conform(source, {"ts": "@timestamp", "severity": "level"})


def source(spark):
    return spark.range(60).selectExpr(
        "TIMESTAMP_NTZ'2026-06-01 00:00:00' + make_dt_interval(0, if(id < 20, 1, 7)) AS ts", "if(id % 2 = 0, 'app', 'edge') AS index_name",
        "'Error' AS level", "concat('m', id % 2) AS message_template", "'quiet' AS message", "'h' AS host",
        "named_struct('severity', if(id < 20, 'Error', 'Info')) AS own", "map('line', 'Failed password') AS more", "id AS event_id")


TARGETS = targets_from({"defaults": {"min_errors": 5, "linux_indices": "*", "linux_ssh_fail_threshold": 1, "ingestion_drop_check": False},
                        "targets": [{"name": "app", "indices": "app"},
                                    {"name": "edge", "indices": "edge", "level_field": "own.severity", "linux_message_field": "more.line"},
                                    {"name": "both"}]})


@pytest.mark.parametrize("written", [True, False])
def test_a_fleet_equals_a_watch_for_each_target(spark, written):
    fleet = Fleet(source(spark), TARGETS, SPAN, written=written)
    assert [[t.name for t in w.targets] for w in fleet.watches] == [["app", "both"], ["edge"]]
    together = sorted(map(str, fleet.signals().collect()))
    apart = []
    for t in TARGETS:
        apart += map(str, Watch(conform(source(spark), t.field_names), [t], SPAN).signals().collect())
    assert together == sorted(apart)
    found = {(r.target, r.kind) for r in fleet.signals().collect()}
    assert ("edge", "linux_ssh_bruteforce") in found and ("app", "linux_ssh_bruteforce") not in found
    assert {(r.target, r.w_end): r.err for r in fleet.window_counts.where("target <> 'both'").collect()} == {
        ("app", SPAN.start + 21600): 10, ("app", SPAN.end): 20, ("edge", SPAN.start + 21600): 10, ("edge", SPAN.end): 0}


def test_documents_and_known_fingerprints_of_a_fleet(spark):
    fleet = Fleet(source(spark), TARGETS, SPAN, written=True)
    found = fleet.written_signals()
    documents = fleet.documents(fleet.alerts(found), found).collect()
    decided = incidents.incidents(found, TARGETS).collect()
    assert {d.target for d in documents} == {r.target for r in decided} == {"app", "edge", "both"}
    assert all(d.signals and d.window.total > 0 for d in documents)
    assert {r.target for r in fleet.seen().collect()} == {"app", "edge", "both"}
    known = spark.createDataFrame([("gone", "x", SPAN.end - 1)], "target STRING, fp STRING, last_seen BIGINT")
    assert fleet.seen(known).where("target = 'gone'").count() == 1


def test_a_fleet_with_one_set_of_names_is_one_watch(spark):
    assert len(Fleet(source(spark), [TARGETS[0], TARGETS[2]], SPAN).watches) == 1
