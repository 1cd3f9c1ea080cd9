"""Shapes of plans: what is pushed down, how often rows are exchanged, where Python runs."""

import re

import pytest

import __spark_entry__
from formline.operators import games
from formline.plans import registry
from formline.sources import adapter

SF = "/root/testdata/sf0.001"


def plan(df):
    """The formatted plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pushdown(spark):
    text = plan(registry.scan_filter_pushdown(spark, SF))
    assert "In(o_orderstatus" in text and "GreaterThan(o_totalprice" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>", text)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan(registry.scan_projection(spark, SF))


def test_windows_share_one_exchange(spark):
    from formline.operators import rolling

    starts = registry._counted(spark, SF)
    alone = plan(starts).count("Exchange hashpartitioning")
    out = rolling.pitcher_features(starts, {"k_rate": ("K", "PA"), "swstr_rate": ("Whiffs", "Pitches")}, ("ff_velo",), fip=False, check=False)
    assert plan(out).count("Exchange hashpartitioning") == alone + 1


def test_games_are_exchanged_once(spark):
    raw = adapter.pitches(spark, SF)
    before = plan(raw).count("Exchange hashpartitioning")
    for build in (games.pitcher_games, games.pitch_type_games):
        text = plan(build(raw, 0))
        assert text.count("Exchange hashpartitioning") == before + 1 and text.count("lineitem.parquet") == plan(raw).count("lineitem.parquet")


def test_native_queries(spark):
    allowed = {"html_extract", "lineup_pages", "starter_pages", "ridge_metrics", "boosted_metrics", "ablation_summary"}
    for name, query in registry.queries().items():
        if name not in allowed:
            assert not re.search("Python|Pandas|Arrow", plan(query(spark, SF))), name


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["game_pk", "pitcher", "game_date", "k_rate_P5", "k_rate_std"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
