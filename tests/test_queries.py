"""Every registered query with SQL against DuckDB at the smallest scale, and plan checks."""

import builtins
import dis

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare, connect
from tickflow.operators.regimes import regime_counts, tag_regimes
from tickflow.order import Order
from tickflow.plans.ticks import build_ticks, ticks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    text, _, ok = compare(spark, con, name, SMALL)
    assert ok, text


LLM = {"pipeline"} | {n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_query_without_sql(spark, name):
    """Learned results: rows are there, scores are probabilities, and they beat chance where the target is known."""
    rows = entry.queries()[name](spark, SMALL).toPandas()
    assert len(rows)
    if "prob" in rows:
        assert rows["prob"].dropna().between(0, 1).all()
    if {"y", "prob"} <= set(rows):
        order = rows["prob"].rank()
        n, p = len(rows), rows["y"].sum()
        assert (order[rows["y"] == 1].sum() - p * (p + 1) / 2) / (p * (n - p)) > 0.4
    if "importance" in rows:
        assert rows["importance"].notna().all()


def test_names_in_queries_are_defined():
    """A name that a query reads is in its module (a query without SQL may else fail only when it is run)."""
    for name, run in entry.queries().items():
        read = {i.argval for i in dis.get_instructions(run) if i.opname == "LOAD_GLOBAL"}
        assert not {n for n in read if n not in run.__globals__ and not hasattr(builtins, n)}, name


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(TABLES) == 14 and duckdb.__version__


def test_flagship(spark):
    rows = {r["model"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"mi_up", "mi_down", "md_up", "md_down", "mw_up", "mw_down"}


def test_known_regime_counts(spark):
    rows = {r["model"]: r["n"] for r in regime_counts(tag_regimes(ticks(spark, "/root/testdata/sf0.01"))).collect()}
    assert rows == {"md_down": 895, "md_up": 867, "mi_down": 450, "mi_up": 482, "mw_down": 1196, "mw_up": 1088}


def test_trade_table_does_not_depend_on_blocks(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    a = build_ticks(events).orderBy("date_trd", "trd_id").collect()
    b = build_ticks(events, Order(block_rows=4, broadcast_rows=0), partitions=9).orderBy("date_trd", "trd_id").collect()
    assert a == b


def test_look_backs_share_one_shuffle(spark):
    from tickflow.operators.features import basic_features
    df = basic_features(ticks(spark, SMALL, True), ["price", "volume", "book"])
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") + plan.count("Window ") >= 1


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_quantity > 30").select("l_tax")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan
