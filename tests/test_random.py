import numpy as np
from pyspark.sql import functions as F

from foreunc.functions.random import Draws, poisson_one

DRAWS = Draws(42)


def test_columns_equal_arrays(spark):
    rows = (
        spark.range(1, 2001)
        .select("id", DRAWS.uniform("p", "id").alias("u"), DRAWS.normal("n", "id", "id % 37").alias("z"))
        .toPandas()
    )
    ids = rows["id"].to_numpy()
    assert np.array_equal(rows["u"], DRAWS.uniform_values("p", ids))
    assert np.abs(rows["z"] - DRAWS.normal_values("n", ids, ids % 37)).max() < 1e-14


def test_independent_of_partitioning(spark):
    df = spark.range(1000).select("id", DRAWS.normal("n", "id").alias("z"))
    one = df.coalesce(1).orderBy("id").collect()
    many = df.repartition(64).orderBy("id").collect()
    assert one == many


def test_uniformity_and_serial_independence():
    ids = np.arange(1, 200_001)
    for seed in range(5):
        u = Draws(seed).uniform_values("p", ids)
        counts, _ = np.histogram(u, 100, (0, 1))
        chi2 = ((counts - 2000) ** 2 / 2000).sum()
        assert abs(chi2 - 99) / np.sqrt(2 * 99) < 4.5
        for lag in (1, 2, 16, 1024):
            assert abs(np.corrcoef(u[:-lag], u[lag:])[0, 1]) * np.sqrt(len(u)) < 4.5


def test_normal_moments_and_lead_independence():
    z = DRAWS.normal_values("n", np.arange(1, 20_001)[:, None], np.arange(1, 38)[None, :])
    assert abs(z.mean()) * np.sqrt(z.size) < 4.5
    assert abs(z.var() - 1) * np.sqrt(z.size / 2) < 4.5
    assert abs((z**4).mean() - 3) * np.sqrt(z.size / 96) < 4.5
    off = np.corrcoef(z.T)[np.triu_indices(37, 1)]
    assert np.abs(off).max() * np.sqrt(len(z)) < 5


def test_purposes_and_seeds_differ():
    ids = np.arange(1, 50_001)
    a, b, c = Draws(1).uniform_values("p", ids), Draws(1).uniform_values("q", ids), Draws(2).uniform_values("p", ids)
    for x in (b, c):
        assert abs(np.corrcoef(a, x)[0, 1]) * np.sqrt(len(a)) < 4.5


def test_index_range_and_poisson(spark):
    row = (
        spark.range(20_000)
        .select(DRAWS.index("m", 31, "id").alias("k"), DRAWS.uniform("b", "id").alias("u"))
        .withColumn("n", poisson_one("u"))
        .agg(F.min("k"), F.max("k"), F.countDistinct("k"), F.avg("n"), F.var_samp("n"))
        .first()
    )
    assert row[:3] == (1, 31, 31)
    assert abs(row[3] - 1) < 0.03 and abs(row[4] - 1) < 0.05
