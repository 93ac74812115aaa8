"""Retrieval, catalogue, validation, log and result shaping on small frames."""

import json
import os
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from clientele.functions.text import strip_fences
from clientele.operators import catalog, corpus, qlog, shape, validation
from clientele.operators.sampling import first_n_users
from clientele.operators.sessionize import session_table
from clientele.operators.similarity import similar, similar_lsh
from clientele.schemas import USER_AGGREGATES
from clientele.session import scratch_dir
from clientele.sources import tables
from clientele.streaming import daily

SF_DIR = "/root/testdata/sf0.001"
VECTORS = "id string, embedding array<float>, tenant string"


@pytest.fixture(scope="module")
def vectors(spark):
    corpus_rows = [("a", [1.0, 0.0], "x"), ("b", [3.0, 4.0], "y"), ("c", [0.0, 1.0], "x"), ("d", [0.0, 0.0], "x"),
                   ("e", None, "x"), ("longer id", [1.0, 0.0], "y")]
    asked = spark.createDataFrame([("q", [1.0, 0.0], "x")], VECTORS.replace("id", "qid"))
    return asked, spark.createDataFrame(corpus_rows, VECTORS)


@pytest.mark.parametrize("options", [{}, {"strategy": "blocks", "block_rows": 2}])
def test_similar(vectors, options):
    def ids(**more):
        return [r.id for r in similar(*vectors, **{"k": 3, **more}, **options).orderBy("rank").collect()]
    assert ids() == ["a", "longer id", "b"]                 # ties by id; zero and NULL vectors never match
    assert ids(threshold=0.6) == ["a", "longer id"]         # exactly at the threshold is out
    assert ids(k=2, post_filter=["tenant"]) == ["a"]        # filtered after the limit: fewer than k
    assert ids(k=2, pre_filter=["tenant"]) == ["a", "c"]
    assert ids(k=2, metric="ip") == ["b", "a"]
    assert ids(k=1, metric="l2") == ["a"]


def test_hot_group_of_copies(spark):
    copies = spark.range(3000).select(F.col("id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    asked = copies.where("id < 2").withColumnRenamed("id", "qid")
    found = similar(asked, copies, 3, strategy="blocks", block_rows=500).orderBy("qid", "rank").collect()
    assert [r.id for r in found] == [0, 1, 2, 0, 1, 2]


def test_lsh_finds_near_copies(spark):
    """Every one of 100 vectors has a copy with a little noise; nothing else is near."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(100, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.1 * rng.normal(size=(100, 64))]))]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = stored.withColumnRenamed("id", "qid")
    found = similar_lsh(asked, stored, 1, 0.9, exclude_same_id=True).collect()
    assert sum(abs(r.qid - r.id) == 100 for r in found) >= 198 and len(found) <= 200


def test_scan_in_bundles(spark, vectors):
    asked, stored = vectors
    many = asked.unionByName(asked.withColumn("qid", F.lit("r")))
    one = similar(many, stored, 3).collect()
    assert sorted(one) == sorted(similar(many, stored, 3, query_rows=1).collect()) and len(one) == 6


def test_upsert_keeps_the_stored_and_the_first(spark):
    stored = spark.createDataFrame([("1", "old")], "id string, sql string")
    batch = spark.createDataFrame([("1", "new", 0), ("2", "late", 2), ("2", "early", 1)], "id string, sql string, n int")
    out = corpus.upsert_ignore(stored, batch, "id", ["n"])
    assert sorted(map(tuple, out.collect())) == [("1", "old"), ("2", "early")]


def test_context_and_route(spark):
    found = spark.createDataFrame([(1, 2, "B?", "x"), (1, 1, "A?", "a\n  b")], "qid int, rank int, question string, sql_query string")
    text = corpus.examples_context(found).first().context
    assert text == "[Good SQL Examples]:\n- Question:\nA?\n-SQL Query:\na b\n\n- Question:\nB?\n-SQL Query:\nx\n\n"
    asked = spark.createDataFrame([(1,), (2,)], "qid int")
    assert sorted(map(tuple, corpus.model_route(asked, found).collect())) == [(1, "fast"), (2, "fine")]


def reply(classification="global", scope="global", relevant=True, **drop):
    column = {"name": "c", "scope": scope, "is_relevant": relevant}
    return json.dumps({"filters": [{"name": "f", "classification": classification, "columns": [column]}],
                       "reversed_question": "q"})


def test_validation(spark):
    texts = {
        "good": reply(), "both": reply("time-dependent", "both"), "scope": reply("time-dependent"),
        "two": reply("global", "time-dependent", False), "cut": reply()[:40], "no filters": '{"reversed_question": "q"}',
        "text flag": reply(relevant="maybe"), "no column": '{"filters": [{"name": "f", "classification": "global"}], "reversed_question": "q"}',
        "empty": '{"filters": [], "reversed_question": "q"}', "line feed": reply().replace('"q"', '"q\n"')}
    rows = spark.createDataFrame(list(texts.items()), "query_id string, reply string")
    got = {r.query_id: r for r in validation.score_validation(rows).collect()}
    assert {k for k, r in got.items() if r.is_matching} == {"good", "both", "text flag", "empty", "line feed"}
    assert got["scope"].mismatch_details == (
        "- \"f\" is implemented using column 'c' with scope 'global'. Use a column with scope 'time-dependent' instead.\n")
    assert got["two"].mismatch_details.count("\n") == 2
    for name in ("cut", "no filters", "no column"):
        assert got[name].mismatch_details == "Returned JSON malformed" and got[name].reversed_question is None


def test_errors(spark):
    rows = spark.createDataFrame([("Reason: 404 gone\n\nLocation: EU", 0), ("Reason: 503 x", 5), ("Reason: 503 x", 1),
                                  ("nothing", 0), (None, 0)], "error_msg string, tries int")
    got = qlog.classify_errors(qlog.parse_errors(rows), retries="tries").collect()
    assert [(r.error_code, r.error_type, r.retryable) for r in got] == [
        (404, "Bad SQL Query", False), (503, "Warehouse Internal Error", False), (503, None, True),
        (None, "Undefined Warehouse Error", False), (None, None, False)]
    assert got[0].error_text == "Reason: 404 gone"


def test_coerce(spark):
    rows = spark.createDataFrame([("2024-01-05", "1", "1.5", "2024-01-01", None), ("2024-1-6", "-2", "7", "soon", None)],
                                 "d string, i string, n string, mixed string, empty string")
    assert [f.dataType for f in shape.coerce_types(rows).schema] == [
        T.DateType(), T.LongType(), T.DoubleType(), T.StringType(), T.DateType()]


def test_chart(spark):
    rows = spark.createDataFrame([("2024-01-01", "a", "x", 1.0), ("2024-01-01", "a", "x", None), ("2024-01-01", "b", "y", 4.0),
                                  (None, "a", "x", 9.0)], "d string, p string, q string, v double")
    rows = rows.withColumn("d", F.to_date("d"))
    chart, is_chart = shape.to_chart(rows)
    assert is_chart and chart.columns == ["d", "a / x", "b / y"] and tuple(chart.first())[1:] == (0.5, 4.0)
    tall, _ = shape.to_chart(rows, wide=False)
    assert sorted(r.v for r in tall.collect()) == [0.5, 4.0]
    assert shape.result_kind(rows.limit(1)).first().kind == "audience"
    assert shape.result_kind(rows.select("d", "v")).first().kind == "series"


def test_catalogue(spark):
    fields = catalog.schema_fields(spark, "p", "o", {"user_aggregates": USER_AGGREGATES})
    got = {r.field_path: r for r in fields.collect()}
    assert got["total_purchased_products_by_brands.brand_name"].scope == "global"
    assert got["session_day"].description.endswith("Scope: time-dependent")
    tables = spark.createDataFrame([("p", "o", "t", None)], "project_id string, owner string, table_name string, comments string")
    keys = spark.createDataFrame([], "owner string, table_name string, column_name string, r_owner string, "
                                     "r_table_name string, r_column_name string")
    text = catalog.table_descriptions(tables, fields.where("false"), keys, keys).first().detailed_description
    assert "Primary Key: None" in text and text.startswith("\n  Table: `p.o.t`\n  Owner: o")


def test_first_n_users(spark):
    users = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    assert first_n_users(users, 100).count() == 999          # strictly less than the number of users
    assert first_n_users(users, 10).distinct().count() == 99
    assert first_n_users(users, 0).count() == 0


@pytest.mark.parametrize("master, base", [("local[2]", None), ("local[2]", "/shared/x/"), ("spark://h:1", "/shared/x")])
def test_scratch_dir(master, base):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: base or default),
                              sparkContext=SimpleNamespace(master=master))
    first, second = scratch_dir(session, "t"), scratch_dir(session, "t")
    assert first != second and (base is None or first.startswith("/shared/x/t-"))


def test_no_local_scratch_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default),
                              sparkContext=SimpleNamespace(master="spark://host:1"))
    with pytest.raises(ValueError):
        scratch_dir(session, "t")


def test_strip_fences(spark):
    assert spark.range(1).select(strip_fences(F.lit("```sql SELECT nosql ```")).alias("t")).first().t == " SELECT no "


def test_sessions_of_batches_become_those_of_all_events(spark, tmp_path):
    """Rows in three deliveries, the middle of the month last: sessions close over."""
    raw, source, out = spark.read.parquet(f"{SF_DIR}/events.parquet"), str(tmp_path / "in"), str(tmp_path / "out")
    raw = raw.withColumn("user_id", F.col("user_id") % 3)
    columns = ["user_id", "session_start", "session_end", "n_events"]
    for part in ("event_id % 3 = 0", "event_id % 3 = 2", "event_id % 3 = 1"):
        raw.where(part).write.mode("append").parquet(source)
        parts = daily.run_batches(daily.read_events(spark, source), daily.session_parts, "s", out)
    merged, whole = daily.merge_sessions(parts).select(*columns), session_table(raw).select(*columns)
    assert merged.exceptAll(whole).count() == 0 and merged.count() == whole.count()
    days = daily.daily_totals(daily.run_batches(daily.read_events(spark, source), lambda r: daily.daily_parts(r, ["event_type"]), "d",
                                                str(tmp_path / "days")), ["event_type"])
    assert days.agg(F.sum("n_events")).first()[0] == raw.count()


def test_replacing_a_day_leaves_its_neighbours(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2000-01-01", 1), ("2000-06-01", 2), ("2001-01-01", 3)], "d string, v int").select(
        F.to_timestamp("d").alias("session_day"), "v", F.trunc(F.to_date("d"), "YEAR").alias("session_date"))
    tables.write_table(rows, path, "session_date")
    for _ in range(2):
        tables.replace_days(rows.where("v = 2").withColumn("v", F.lit(9)), path, "session_date")
    assert sorted(r.v for r in tables.read_table(spark, path).collect()) == [1, 3, 9]


def test_store_appends_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = lambda *rows: spark.createDataFrame(rows, "id string, n int")
    corpus.store_new(frame(("a", 2), ("a", 1)), path, "id", ["n"])
    out = corpus.store_new(frame(("a", 0), ("b", 5), ("b", 4)), path, "id", ["n"])
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 4)]


def test_numbers_of_any_kind_make_a_chart(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3)], "p string, v int").select(
        F.to_date(F.lit("2024-01-01")).alias("d"), "p", "v", F.lit("1.50").cast("decimal(5,2)").alias("w"))
    chart, _ = shape.to_chart(shape.coerce_types(rows).drop("w"))
    assert chart.columns == ["d", "a", "b"] and tuple(chart.first())[1:] == (1.0, 3.0)
    wide, single = shape.to_chart(shape.coerce_types(rows))
    assert not single and tuple(wide.first())[1:] == (1.0, 1.5, 3.0, 1.5)


def test_workers_get_the_package(tmp_path):
    """A query from another working folder, in a process of its own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            f"import __spark_entry__ as e\nprint('rows', e.queries()['knn_examples'](s, {SF_DIR!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw = spark.read.parquet(f"{SF_DIR}/events.parquet").coalesce(1)
    half = raw.agg(F.expr("percentile_approx(event_id, 0.5)").alias("h")).first().h

    def run():
        rows = daily.read_events(spark, source).select(F.col("event_id").alias("id"), "ts")
        return daily.log_sink(rows, "log", out).count()

    raw.where(F.col("event_id") <= half).write.parquet(source)
    first = run()
    raw.where(F.col("event_id") > half).write.mode("append").parquet(source)
    assert 0 < first < raw.count() and run() == raw.count()
