import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from foreunc.functions import scalar
from foreunc.operators import prepare
from foreunc.session import cut_lineage
from foreunc.sources import tables

D = datetime.date


def test_strict_and_skipping_means(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", None), ("g2", 2.0)], "g string, x double")
    rows = df.groupBy("g").agg(scalar.strict_mean("x").alias("s"), F.avg("x").alias("a"))
    assert {r.g: (r.s, r.a) for r in rows.collect()} == {"g1": (None, 1.0), "g2": (2.0, 2.0)}


def test_time_grid(spark):
    df = spark.createDataFrame(
        [("S1", D(2024, 1, 1), 1.0), ("S1", D(2024, 1, 4), 2.0), ("S2", D(2024, 1, 2), 3.0)],
        "site_id string, datetime date, x double",
    )
    rows = prepare.complete_grid(df).collect()
    assert len(rows) == 8 and sum(r.x is None for r in rows) == 5


def test_weekly_grid(spark):
    df = spark.createDataFrame(
        [("S1", D(2024, 1, 1), 1.0), ("S1", D(2024, 1, 15), 2.0)],
        "site_id string, datetime date, x double",
    )
    days = [r.datetime for r in prepare.complete_grid(df, step=7).orderBy("datetime").collect()]
    assert days == [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 15)]


def test_two_values_in_a_cell_are_an_error(spark):
    df = spark.createDataFrame([("a", "v", 1.0), ("a", "v", 2.0)], "k string, variable string, prediction double")
    with pytest.raises(Exception, match="more than one value"):
        prepare.widen(df, ["k"], ["v"]).collect()


def test_guards(spark):
    df = spark.createDataFrame(
        [("a", None, 1.0), ("b", 1.0, None), ("c", -1.0, 2.0)],
        "site_id string, y double, air_temperature double",
    )
    got = {r.site_id: (r.status, r.has_negative) for r in prepare.target_status(df, "y").collect()}
    assert got == {"a": ("no_target", False), "b": ("no_overlap", False), "c": ("ok", True)}


def test_flag_predicate_needs_a_match(spark):
    with pytest.raises(ValueError):
        prepare.any_flag(spark.range(1), "nothing")


def test_box_cox_round_trip(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (30.0,)], "x double")
    for lam in (0.0, 0.3, 1.5):
        back = df.select("x", scalar.box_cox("x", lam).alias("b")).select(
            "x", scalar.inverse_box_cox("b", lam).alias("r"),
            scalar.inverse_box_cox("b", lam, shift=1.0).alias("s"),
        )
        for r in back.collect():
            assert r.r == pytest.approx(r.x) and r.s == pytest.approx(r.x - 1)


def test_unknown_theme(spark):
    with pytest.raises(ValueError, match="unknown theme"):
        tables.read_targets(spark, "/nowhere", "weather")


def test_targets_with_new_names_and_bad_cells(spark, tmp_path):
    folder = tmp_path / "ticks"
    folder.mkdir()
    path = folder / "ticks-targets.csv.gz"
    import gzip

    with gzip.open(path, "wt") as f:
        f.write("site_id,variable,datetime,observation\nA,n,2024-01-01,1.5\nB,n,2024-01-02,NA\n")
    rows = tables.read_targets(spark, str(tmp_path), "ticks").orderBy("site_id").collect()
    assert [tuple(r) for r in rows] == [
        (D(2024, 1, 1), "A", "n", 1.5), (D(2024, 1, 2), "B", "n", None),
    ]
    assert tables.read_targets(spark, str(tmp_path), "ticks", ["B"]).count() == 1


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert tables.read_or_build(spark, path, build).count() == 3
    assert tables.read_or_build(spark, path, build).count() == 3
    assert calls == [1]


def test_driver_filters_reach_the_scan(spark, tmp_path):
    rows = [("A", datetime.datetime(2024, 1, d), "t", 1, 1.0) for d in (1, 2)]
    spark.createDataFrame(rows, tables.DRIVER_SCHEMA).write.parquet(str(tmp_path / "2024-01-01"))
    df = tables.read_driver_forecast(
        spark, str(tmp_path), "2024-01-01", sites=["A"], variables=["t"], start="2024-01-02"
    )
    assert df.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(datetime" in plan


def test_append_drops_incomplete_rows(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    b = spark.createDataFrame([(5.0, 3)], "x double, k int")
    assert sorted(r.k for r in prepare.append_complete(a, None, b).collect()) == [1, 3]
    with pytest.raises(ValueError):
        prepare.append_complete(None)


def test_checkpoint_folder_is_the_configured_one(spark):
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_half_hourly_targets_keep_their_time(spark, tmp_path):
    folder = tmp_path / "terrestrial_30min"
    folder.mkdir()
    text = "time,siteID,variable,observation\n2024-01-01 00:30:00,A,nee,1.5\n2024-01-01T13:00:00Z,A,nee,NA\n"
    with gzip.open(folder / "terrestrial_30min-targets.csv.gz", "wt") as f:
        f.write(text)
    rows = tables.read_targets(spark, str(tmp_path), "terrestrial_30min").collect()
    assert [(r.datetime.hour, r.datetime.minute, r.observation) for r in rows] == [(0, 30, 1.5), (13, 0, None)]


def test_malformed_cells_fail_on_request(spark, tmp_path):
    folder = tmp_path / "ticks"
    folder.mkdir()
    with gzip.open(folder / "ticks-targets.csv.gz", "wt") as f:
        f.write("datetime,site_id,variable,observation\n2024-01-01,A,x,NA\n2024-01-02,A,x,oops\n")
    lenient = tables.read_targets(spark, str(tmp_path), "ticks").collect()
    assert [r.observation for r in lenient] == [None, None]
    with pytest.raises(Exception, match="oops"):
        tables.read_targets(spark, str(tmp_path), "ticks", malformed="fail").collect()
