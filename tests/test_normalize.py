import json

from pyspark.sql import functions as F

from sentinel.operators import normalize
from sentinel.sources.event_logs import raw_documents


def run(spark, *documents):
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents], "document STRING")
    return normalize.normalize(rows).drop("document").collect()


def test_tag_folding(spark):
    out = run(spark, {"message": "x", "labels": {"LogTags": "import,chessboard"}},
              {"message": "y", "metadata": {"LogTags": "crawl"}}, {"message": "z", "tags": ["daily"]},
              {"labels": {"LogTags": " a,\ta , ,b\n"}, "tags": ["x", "x", "a"]},
              {"labels": {"LogTags": 7}}, {"message": "no object"}, {"tags": "one", "labels": {}})
    assert [r.tags for r in out] == [
        ["import", "chessboard"], ["crawl"], ["daily"], ["x", "x", "a", "b"], [], None, ["one"]]
    assert "LogTags" not in out[0].labels and out[0].labels["schema_version"] == "1"


def test_renames_and_overrides(spark):
    out = run(spark, {
        "level": "Error", "labels": {"Username": "a", "UserName": "b", "Application": "app"},
        "fields": {"UserName": "c", "StatusCode": 401, "RequestPath": "/livez",
                   "SourceContext": "Microsoft.Hosting.Lifetime"}, "user": {"name": "own"}},
        {"log.level": "Warning", "service.name": "svc", "labels": {"Username": "a", "UserName": "b"}})
    first, second = out
    assert (first.level, first.user_name, first.service, first.status_code, first.url_path) == (
        "Error", "c", "app", 401, "/livez")
    assert first.tags == ["healthcheck", "request", "auth", "startup"]
    assert first.labels == {"Application": "app", "schema_version": "1"}
    assert (second.level, second.service, second.user_name) == ("Warning", "svc", "b")


def test_text_status_is_a_request_but_no_auth(spark):
    out = run(spark, {"http": {"response": {"status_code": "401"}}},
              {"http": {"response": {"status_code": 401}}}, {"message": "Unauthorized"})
    assert [r.tags for r in out] == [["request"], ["request", "auth"], ["auth"]]


def test_conflict_keeps_the_document_and_stops(spark):
    early, late, null = run(
        spark,
        {"level": "Error", "log": {"level": "Info"}, "labels": {"Username": "u"}, "message": "Heartbeat:"},
        {"fields": {"MachineName": "m", "UserName": "u"}, "host": {"name": "h"}},
        {"level": None, "log": {"level": "Info"}})
    assert early.labels == {"Username": "u", "schema_error": "field [log.level] already exists"}
    assert (early.level, early.user_name, early.service, early.tags) == ("Info", None, None, None)
    assert (late.host, late.user_name, late.schema_error) == ("h", "u", "field [host.name] already exists")
    assert null.schema_error, "a null under the old name still clashes"


def test_defaults_and_broken_json(spark):
    (empty,) = run(spark, {})
    assert (empty.level, empty.service, empty.tags) == ("Information", "unknown", None)
    rows = spark.createDataFrame([("{not json",)], "document STRING")
    assert normalize.normalize(rows).collect()[0].level == "Information"


def test_normalising_again_changes_nothing(spark, events):
    columns = ["ts", "level", "message", "service", "environment", "user_name", "user_id", "logger",
               "host", "url_path", "http_method", "status_code", "status_is_number", "labels"]
    once = normalize.normalize(raw_documents(events)).where("schema_error IS NULL")
    twice = normalize.normalize(normalize.to_document(once))
    # a document without any object gains one (the version label), hence an empty tag list

    def digest(rows):
        return rows.select(
            *[F.to_json(F.struct(F.array_sort(F.map_entries(c)) if c == "labels" else F.col(c))).alias(c)
              for c in columns], F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))

    assert once.count() > 0
    assert digest(once).exceptAll(digest(twice)).count() == 0


def test_backfill_can_run_twice(spark, events, tmp_path):
    path = str(tmp_path / "logs")
    raw = raw_documents(events.where("event_id < 500"))
    normalize.backfill(raw, path)
    first = spark.read.parquet(path).count()
    normalize.backfill(raw, path)
    assert spark.read.parquet(path).count() == first == raw.count()


def test_unknown_keys_survive_two_runs(spark):
    document = {"message": "m", "trace": {"id": "t", "flags": [1, {"x": None}]}, "a.b": {"c": 1.5}, "host": "vm1",
                "http": {"request": {"method": "GET", "bytes": 7}, "version": "2"}, "labels": {"k": "v", "LogTags": "x"},
                "metadata": {"LogTags": "y", "z": "5"}, "fields": {"UserName": "u", "Own": {"deep": True}}}
    left = {"trace": {"flags": [1, {"x": None}]}, "a.b": {"c": 1.5}, "host": "vm1",
            "http": {"request": {"bytes": 7}, "version": "2"}, "metadata": {"z": "5"}, "fields": {"Own": {"deep": True}}}
    rows = normalize.normalize(spark.createDataFrame([(json.dumps(document),)], "document STRING"))
    for _ in range(3):
        (row,) = rows.collect()
        assert json.loads(row.rest) == left
        assert (row.http_method, row.trace_id, row.user_name, row.tags) == ("GET", "t", "u", ["x", "y"])
        rows = normalize.normalize(normalize.to_document(rows))


def test_rest_is_null_when_all_is_consumed(spark):
    rows = run(spark, {"message": "m", "log": {"level": "Info"}}, {}, {"user.name": "flat", "tags": ["t"]})
    assert [r.rest for r in rows] == [None, None, None] and rows[2].user_name == "flat"


def test_odd_documents(spark):
    rows = spark.createDataFrame([(None,), ("[1]",), ('{"level":"x","log":{',), ('{"log":"text","level":"Error"}',)],
                                 "document STRING")
    found = normalize.normalize(rows).collect()
    assert len(found) == 4 and {r.service for r in found} == {"unknown"}
    assert found[3].level == "Error" and json.loads(found[3].rest) == {"log": "text"}


def test_columns_that_nobody_reads_are_not_computed(spark):
    rows = normalize.normalize(spark.createDataFrame([("{}",)], "document STRING"))
    plan = normalize.without_noise(rows).select("ts", "level")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_concat" not in plan and "to_json" not in plan and plan.count("from_json") == 1


def test_a_document_is_made_without_parsing_again(spark):
    documents = [{"event_id": 1, "message": "m", "own": {"a": [1, None]}}, {"message": "n"},
                 {"host": {"name": "h", "os": "x"}, "log": "text", "http": {"request": {"method": "GET", "bytes": 7}}}]
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents], "document STRING").coalesce(1)
    again = [json.loads(r.document) for r in normalize.to_document(normalize.normalize(rows)).collect()]
    common = {"service": {"name": "unknown"}, "labels": {"schema_version": "1"}}
    level = {"log": {"level": "Information"}}
    assert again == [  # no empty objects, and what columns and the rest both name is joined
        {"event_id": 1, "message": "m", "own": {"a": [1, None]}, **level, **common}, {"message": "n", **level, **common},
        {**common, "log": "text", "host": {"name": "h", "os": "x"}, "http": {"request": {"method": "GET", "bytes": 7}}}]


def test_objects_of_a_document_are_read_once(spark):
    rest = normalize.rest_of("document", "fail_stage")
    # the document, labels, http and one of its members' two objects, any other root
    assert rest.count("'map<string,variant>'") == 6 and "array_contains" not in rest
    plan = normalize.normalize(spark.createDataFrame([("{}",)], "document STRING"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapType(StringType,StringType,true), false") == 1 and "$.UserName" not in plan


def test_flat_keys_and_dots_in_texts(spark):
    rows = run(spark, {"message": "a.b\": . .. log.level", "log.level": "Warning", "http.response.status_code": 401},
               {"message": "m", "labels.UserName": "u"},
               {"message": "m", "labels": {"LogTags": 5, "UserName": None, "Username": 7}})
    assert (rows[0].level, rows[0].status_code, rows[0].tags) == ("Warning", 401, ["request", "auth"])
    assert (rows[1].tags, rows[1].user_name) == (None, "u")
    assert (rows[2].tags, rows[2].user_name) == ([], "7")
