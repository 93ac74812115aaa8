"""What moves through shuffles, and how much of it meets in a task."""

import datetime as dt

import pytest

from clientele import session
from clientele.operators import sessions as sess
from clientele.plans import answer_queries, dataset
from clientele.sources import demo


@pytest.fixture(scope="module")
def shop_dir(spark, tmp_path_factory):
    """Orders that come twice, of nobody and of a stranger, without lines; lines without order, part or number."""
    path, at = str(tmp_path_factory.mktemp("shop")), dt.datetime(2000, 1, 5)
    made = {
        "nation": ([(1, "N1"), (2, "N2")], "n_nationkey int, n_name string"),
        "customer": ([(1, "c1", 1, "A"), (2, "c2", None, "B")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(1, "p1", "b1", "t1", 3, 10.0), (2, "p2", None, None, None, None), (2, "p2b", "b2", "t2", 40, 0.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(2, 1, "F", 1.0, at, "1-URGENT"), (2, 2, "P", 1.0, at, "2-HIGH"), (2, 2, "P", 1.0, at, "2-HIGH"), (3, None, "F", 1.0, at, "5-LOW"),
                    (4, 9, "F", 1.0, at, "5-LOW"), (6, 1, "O", 1.0, at, None), (8, 1, None, 1.0, at, "5-LOW"), (None, 1, "F", 1.0, at, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(2, 1, 1, "R"), (2, 2, 2, "N"), (2, 2, 2, "N"), (2, 7, 3, "N"), (3, 1, 1, "N"), (4, 1, 1, "N"), (8, None, None, "R"),
                      (8, 1, None, None), (None, 1, 1, "N"), (5, 1, 1, "N")],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_products_looked_up_first_give_the_same_sessions(spark, shop_dir):
    known = sess.build_events(demo.session_events(spark, shop_dir), demo.products(spark, shop_dir))
    mine = dataset.demo_nested(spark, shop_dir)
    assert mine.columns == known.columns and mine.count() == known.count() == 3
    assert mine.exceptAll(known).count() == 0


def _plan(spark, df):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_events_are_gathered_after_they_moved(spark, shop_dir):
    """No array of events goes through a shuffle, and none is made of the joined pages."""
    raw = demo.session_events(spark, shop_dir)
    for events, moves in ((sess.build_events(raw, demo.products(spark, shop_dir)), None), (dataset.demo_nested(spark, shop_dir), 1)):
        plan = _plan(spark, events)
        gathered = [i for i, line in enumerate(plan) if "collect_list" in line]
        moved = [i for i, line in enumerate(plan) if "Exchange " in line]
        assert gathered and max(gathered) < min(moved)
        if moves:       # above the join with the sessions nothing moves
            join = min(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
            assert join < min(moved)


@pytest.fixture(scope="module")
def catalogue_dir(spark, tmp_path_factory):
    """Lines that come twice, without order, number, part or supplier; a part and an order that come twice."""
    path = str(tmp_path_factory.mktemp("catalogue"))
    made = {
        "part": ([(1, "p1", 30), (2, "p2", 7), (2, "p2b", None)], "p_partkey long, p_name string, p_size int"),
        "orders": ([(1, "F", "1-URGENT"), (2, "O", "5-LOW"), (2, "P", "5-LOW"), (3, None, "5-LOW"), (4, "F", None), (None, "F", "5-LOW")],
                   "o_orderkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(1, 1, 7, 2, "O"), (1, 1, 7, 2, "O"), (1, 2, 7, 1, "F"), (1, 2, 8, 1, None), (1, None, 7, 3, "O"), (1, 1, 7, None, "F"),
                      (2, 1, None, 1, "F"), (4, 1, 7, 1, "O"), (None, 1, 7, 1, "O"), (9, 1, 7, 1, "O")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_rows_of_a_catalogue_move_by_table(spark, catalogue_dir):
    """Fields and tables move by the name of the table alone, so they are joined and gathered without moving again."""
    found = answer_queries.table_descriptions(session.tune(spark), catalogue_dir)
    moved = [line.split("hashpartitioning(")[1].split("]")[0] for line in _plan(spark, found)
             if "Exchange hashpartitioning(" in line and "Reused" not in line]
    several = [keys for keys in moved if keys.count("#") > 1]
    assert len(several) == 1 and "l_partkey" in several[0], moved      # the distinct lines, as numbers

    def text(n, owner, columns, primary, foreign, comment):
        lines = " \n  ".join(f"- {c} ({kind}) - {said}" for c, kind, said in columns)
        refs = ",".join(f"\n      Column {c} is equal to column {p} in table stock.{s}\n      " for c, p, s in foreign) or "None"
        return (f"\n  Table: `shop.{owner}.order_{n}`\n  Owner: {owner}\n  Columns:\n  {lines}\n  Primary Key: {primary}"
                f"\n  Foreign Keys: {refs}\n  Project_id: shop\n  Table Description: {comment}")
    one = [("c1.p2", "INT64", "p2 - Scope: time-dependent"), ("c1.p2", "INT64", "p2b - Scope: none"), ("c2.p1", "STRING", "p1 - Scope: global")]
    # a repeated order doubles its columns and its paths
    known = [text(1, "1-URGENT", one, "c2,c3", [("c1", "p2", "supplier_7"), ("c1", "p2", "supplier_8")], "Order in state F"),
             text(3, "5-LOW", [], "None", [], "None")]
    got = sorted(r["detailed_description"] or "" for r in found.collect())
    assert [t for t in got if "order_1`" in t or "order_3`" in t] == known
    doubled = [t for t in got if "order_2`" in t]
    assert len(doubled) == 2 and all(t.count("- c1.p1 (STRING) - p1 - Scope: global") == 4 for t in doubled), doubled


def test_parts_of_shuffles_are_bounded(spark):
    size, parts = session._SIZE, session._PARTS
    mine = spark.newSession()
    for given, wanted in (("64MB", str(session.PART_BYTES)), ("16k", "16k"), ("1g", str(session.PART_BYTES)), ("100000b", "100000b")):
        mine.conf.set(size, given)
        assert session.bound_tasks(mine).conf.get(size) == wanted
    assert mine.conf.get(parts) == str(session.LEAST_PARTS)
    assert session.free_tasks(mine).conf.get(parts, None) is None
    mine.conf.set("spark.sql.shuffle.partitions", "600")
    assert session.bound_tasks(mine).conf.get(parts, None) is None


def test_years_are_stored_without_another_shuffle(spark, shop_dir, tmp_path):
    """The stored tables of years are those of days, and a heavy user's too."""
    tables = [dataset.build(spark, demo.users(spark, shop_dir), demo.products(spark, shop_dir), demo.session_events(spark, shop_dir),
                            str(tmp_path / grain), grain, events=events)
              for grain, events in (("DAY", None), ("YEAR", dataset.demo_nested(spark, shop_dir)))]
    for name in ("user_aggregates", "product_aggregates", "user_daily"):
        days, years = (t[name].drop(dataset.PARTITION) for t in tables)
        assert days.count() == years.count() > 0 and days.exceptAll(years).count() == 0
