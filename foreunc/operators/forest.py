"""Random-forest forecast model: scaling, tuning, fit, standard errors and predictive draws."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreunc.functions.random import Draws, poisson_one
from foreunc.functions.scalar import rmse
from foreunc.operators.evaluate import top_by_metric
from foreunc.operators.propagate import column_values
from foreunc.session import ensure_checkpoint_dir
from foreunc.sources.tables import path_exists, save_model

# Target variables of each theme that has a forest model.
TARGET_VARIABLES = {
    "aquatics": ("temperature", "oxygen", "chla"),
    "phenology": ("gcc_90",),
    "terrestrial_daily": ("nee", "le"),
    "beetles": ("abundance", "richness"),
    "ticks": ("amblyomma_americanum",),
}

# Forest size and resampling plan of the full-scale model.
TREES, FOLDS, REPEATS, GRID = 500, 10, 5, 20
#: Trees stop by the size of their leaves; this is the greatest depth the engine allows.
DEPTH = 30


# -- scaling ---------------------------------------------------------------------------------------


def scaling_stages(predictors: Sequence[str], features: str = "features") -> list:
    """Standardise predictors with training mean and sd (sample sd); the outcome is left alone."""
    return [
        VectorAssembler(inputCols=list(predictors), outputCol=f"raw_{features}"),
        StandardScaler(
            withMean=True, withStd=True, inputCol=f"raw_{features}", outputCol=features
        ),
    ]


def fit_scaling(train: DataFrame, predictors: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=scaling_stages(predictors)).fit(train)


def scaling_table(train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Means and sds as one row, for models written as column expressions."""
    return train.agg(
        *[F.avg(p).alias(f"mean_{p}") for p in predictors],
        *[F.stddev_samp(p).alias(f"sd_{p}") for p in predictors],
    )


def scale_columns(df: DataFrame, statistics: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Apply stored statistics to new data."""
    return df.withColumns(
        {
            p: (F.col(p) - statistics.select(f"mean_{p}").scalar())
            / statistics.select(f"sd_{p}").scalar()
            for p in predictors
        }
    )


# -- fit and tune ----------------------------------------------------------------------------------


def forest(
    label: str, mtry: int, min_n: int, trees: int = TREES, seed: int = 42, depth: int = DEPTH
) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        featureSubsetStrategy=str(mtry),
        minInstancesPerNode=min_n,
        maxDepth=depth,
        seed=seed,
    )


def fit_forest(train: DataFrame, label: str, predictors: Sequence[str], **params) -> PipelineModel:
    stages = [*scaling_stages(predictors), forest(label, **params)]
    return Pipeline(stages=stages).fit(train)


def assign_folds(
    df: DataFrame, draws: Draws, row_id: str, folds: int = FOLDS, repeats: int = REPEATS
) -> DataFrame:
    """Fold numbers 0..folds-1 for every repeat, columns ``fold_1..``; a function of the row id."""
    return df.withColumns(
        {
            f"fold_{r}": (draws.index(f"fold:{r}", folds, row_id) - 1).cast("int")
            for r in range(1, repeats + 1)
        }
    )


def tuning_grid(n_predictors: int, size: int = GRID, seed: int = 42) -> list[tuple[int, int]]:
    """Distinct (mtry, min_n) pairs, drawn in 1..p and 2..40."""
    draws = Draws(seed)
    ids = np.arange(1, 50 * size)
    mtry = 1 + (draws.uniform_values("mtry", ids) * n_predictors).astype(int)
    min_n = 2 + (draws.uniform_values("min_n", ids) * 39).astype(int)
    return list(dict.fromkeys(zip(mtry.tolist(), min_n.tolist())))[:size]


LEDGER = "theme string, target string, repeat int, fold int, mtry int, min_n int, rmse double"


def tune_forest(
    train: DataFrame,
    label: str,
    predictors: Sequence[str],
    draws: Draws,
    row_id: str,
    folds: int = FOLDS,
    repeats: int = REPEATS,
    grid: Sequence[tuple[int, int]] | None = None,
    trees: int = TREES,
    depth: int = DEPTH,
    parallelism: int = 4,
    ledger: str | None = None,
    theme: str = "",
) -> DataFrame:
    """Repeated cross-validation: mean RMSE per (mtry, min_n) over all repeats and folds.

    Fits run side by side, ``parallelism`` at a time. With ``ledger``, a folder, each finished fit leaves
    a row there (columns LEDGER), and a run that starts again only does the fits that lack one; a ledger
    belongs to one table, forest size and grid. A fold without rows gives no row.
    """
    spark = train.sparkSession
    grid = list(grid or tuning_grid(len(predictors)))
    wanted = [(r, f, m, k) for r in range(1, repeats + 1) for f in range(folds) for m, k in grid]
    found = []
    if ledger and path_exists(spark, ledger):
        # One row per fit of this target: at most repeats x folds x grid.
        past = read_ledger(spark, ledger).where((F.col("theme") == theme) & (F.col("target") == label))
        found = [tuple(r) for r in past.select("repeat", "fold", "mtry", "min_n", "rmse").distinct().collect()]
    done = {row[:4] for row in found}
    rest = [w for w in wanted if w not in done]
    if rest:
        # Trees split on order alone, so one scaling for all folds changes no candidate's error.
        folded = (
            fit_scaling(train, predictors)
            .transform(assign_folds(train, draws, row_id, folds, repeats))
            .select("features", label, *[f"fold_{r}" for r in range(1, repeats + 1)])
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

        def one_fit(at: tuple[int, int, int, int]):
            repeat, fold, mtry, min_n = at
            inside = F.col(f"fold_{repeat}") == fold
            model = forest(label, mtry, min_n, trees, depth=depth).fit(folded.where(~inside))
            error = model.transform(folded.where(inside)).agg(rmse("prediction", label).alias("e")).first()["e"]
            if error is not None and ledger:
                # A folder of its own, as fits that end together must not share a commit.
                row = spark.createDataFrame([(theme, label, *at, float(error))], LEDGER)
                row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{theme}-{label}-{'-'.join(map(str, at))}")
            return None if error is None else (*at, float(error))

        try:
            with ThreadPool(parallelism) as pool:
                found += [row for row in pool.imap_unordered(one_fit, rest) if row is not None]
        finally:
            folded.unpersist()
    # Errors are summed in a fixed order, whichever fit came first.
    sums: dict[tuple[int, int], list[float]] = {}
    for _, _, m, k, error in sorted(row for row in found if row[:4] in set(wanted)):
        sums.setdefault((m, k), []).append(error)
    rows = [(m, k, float(np.mean(errors)), len(errors)) for (m, k), errors in sums.items()]
    return spark.createDataFrame(rows, "mtry int, min_n int, rmse double, fits int")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Finished fits of all targets that share a ledger."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)


def best_parameters(tuning: DataFrame) -> dict:
    """Lowest mean RMSE; ties go to the smaller parameters."""
    row = top_by_metric(tuning, [], "rmse", ["mtry", "min_n"]).first()
    return row.asDict()


def importance_table(spark: SparkSession, model: PipelineModel, predictors: Sequence[str]):
    """Impurity importance, one row per predictor."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(p, float(v)) for p, v in zip(predictors, values)], "variable string, importance double"
    )


def training_report(
    spark: SparkSession,
    theme: str,
    target: str,
    predictors: Sequence[str],
    n_obs: int,
    folds: int,
    rmse_train: float,
    rmse_cv: float,
    mtry: int,
    min_n: int,
    importance: Sequence[float],
) -> DataFrame:
    """Summary row of a trained model, importances as ``importance_<predictor>`` columns."""
    head = (
        "theme string, site string, predictor_formula string, n_obs bigint, n_vfolds string, "
        "target_variable string, rmse double, rmse_cv double, mtry int, min_n int"
    )
    tail = "".join(f", `importance_{p}` double" for p in predictors)
    row = (
        theme, "all sites", " + ".join(predictors), int(n_obs), str(folds), target,
        float(rmse_train), float(rmse_cv), int(mtry), int(min_n), *[float(v) for v in importance],
    )
    return spark.createDataFrame([row], head + tail)


def train_target(
    train: DataFrame,
    theme: str,
    target: str,
    predictors: Sequence[str],
    draws: Draws,
    row_id: str,
    model_to: str | None = None,
    folds: int = FOLDS,
    repeats: int = REPEATS,
    grid: Sequence[tuple[int, int]] | None = None,
    trees: int = TREES,
    depth: int = DEPTH,
    parallelism: int = 4,
    ledger: str | None = None,
) -> tuple[PipelineModel | None, DataFrame | None]:
    """Guards, tuning, final fit and report of one target; ``(None, None)`` when unusable.

    With ``ledger`` an interrupted tuning goes on where it stopped, see :func:`tune_forest`.
    """
    if target not in train.columns:
        return None, None
    complete = train.select(row_id, target, *predictors).na.drop("any")
    complete = complete.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_obs = complete.count()
        if n_obs == 0:
            return None, None
        tuning = tune_forest(
            complete, target, predictors, draws, row_id, folds, repeats, grid, trees, depth,
            parallelism, ledger, theme,
        )
        best = best_parameters(tuning)
        model = fit_forest(
            complete, target, predictors,
            mtry=best["mtry"], min_n=best["min_n"], trees=trees, depth=depth,
        )
        error = model.transform(complete).agg(rmse("prediction", target).alias("e")).first()["e"]
    finally:
        complete.unpersist()
    if model_to:
        save_model(model, model_to)
    report = training_report(
        train.sparkSession, theme, target, predictors, n_obs, folds, error, best["rmse"],
        best["mtry"], best["min_n"], model.stages[-1].featureImportances.toArray(),
    )
    return model, report


def train_themes(tables: dict[str, DataFrame], predictors: Sequence[str], draws: Draws,
                 row_id: str, at_once: int = 2, **options) -> list[DataFrame]:
    """Reports of every (theme, variable) with a usable table, in the order of the themes.

    The handful of targets run ``at_once`` side by side, each a set of Spark jobs over all sites together.
    """
    wanted = [(theme, target) for theme in tables for target in TARGET_VARIABLES[theme]]

    def one(at: tuple[str, str]) -> DataFrame | None:
        theme, target = at
        return train_target(tables[theme], theme, target, predictors, draws, row_id, **options)[1]

    with ThreadPool(at_once) as pool:
        return [report for report in pool.map(one, wanted, chunksize=1) if report is not None]


# -- standard errors -------------------------------------------------------------------------------


class BaggedTrees:
    """Trees fitted on hash-Poisson resamples whose in-bag counts are known.

    ``gram`` is the tree x tree matrix of in-bag cross-products, summed over the training rows once.
    The infinitesimal-jackknife variance of a prediction is then ``d' gram d / B^2`` with ``d`` the
    centred tree predictions, so new rows are never paired with training rows.
    """

    def __init__(self, pipeline: PipelineModel, trees: int, gram: np.ndarray, n_train: int):
        self.pipeline, self.trees, self.gram, self.n_train = pipeline, trees, gram, n_train

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        label: str,
        predictors: Sequence[str],
        draws: Draws,
        row_id: str,
        trees: int,
        mtry: int,
        min_n: int,
        depth: int = DEPTH,
        parallelism: int = 4,
    ) -> BaggedTrees:
        bags = [f"bag_{b}" for b in range(trees)]
        scaling = fit_scaling(train, predictors)
        weighted = in_bag_counts(
            scaling.transform(train).select("features", label, row_id), draws, row_id, trees
        ).persist(StorageLevel.MEMORY_AND_DISK)

        def one_tree(b: int):
            tree = RandomForestRegressor(
                featuresCol="features", labelCol=label, predictionCol=f"tree_{b}",
                weightCol=f"bag_{b}", bootstrap=False, numTrees=1, maxDepth=depth,
                featureSubsetStrategy=str(mtry), minInstancesPerNode=min_n, seed=draws.seed + b,
            )
            return tree.fit(weighted.where(F.col(f"bag_{b}") > 0))

        try:
            n_train = weighted.count()
            with ThreadPool(parallelism) as pool:
                models = pool.map(one_tree, range(trees))
            gram = in_bag_gram(weighted.select(F.array(*bags).cast("array<double>").alias("bag")))
        finally:
            weighted.unpersist()
        return cls(PipelineModel([*scaling.stages, *models]), trees, gram, n_train)

    def predict(self, df: DataFrame, se_method: str = "infjack") -> DataFrame:
        """Adds ``prediction`` and ``se``. ``infjack`` is the infinitesimal jackknife with its
        finite-forest correction, floored at 0; ``tree_sd`` the sd between trees."""
        names = [f"tree_{b}" for b in range(self.trees)]
        scored = self.pipeline.transform(df).drop("raw_features", "features")
        scored = scored.withColumn("_t", F.array(*names)).drop(*names)
        scored = scored.withColumn(
            "prediction", F.aggregate("_t", F.lit(0.0), lambda s, t: s + t) / self.trees
        )
        if se_method == "tree_sd":
            spread = F.aggregate(
                "_t", F.lit(0.0), lambda s, t: s + F.pow(t - F.col("prediction"), F.lit(2.0))
            )
            se = F.sqrt(spread / (self.trees - 1))
        else:
            se = _jackknife(self.gram, self.n_train)("_t")
        return scored.withColumn("se", se).drop("_t")

    def save(self, spark: SparkSession, path: str) -> str:
        save_model(self.pipeline, f"{path}/trees")
        rows = [(i, [float(v) for v in row], self.n_train) for i, row in enumerate(self.gram)]
        spark.createDataFrame(rows, "tree int, products array<double>, n_train bigint").write.mode(
            "overwrite"
        ).parquet(f"{path}/in_bag")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BaggedTrees:
        if not path_exists(spark, f"{path}/trees"):
            raise FileNotFoundError(path)
        # Model metadata: one row per tree.
        rows = spark.read.parquet(f"{path}/in_bag").orderBy("tree").collect()
        gram = np.array([r["products"] for r in rows])
        pipeline = PipelineModel.load(f"{path}/trees")
        return cls(pipeline, len(rows), gram, rows[0]["n_train"])


#: Groups of trees, and trees of each: 500 in all.
BAGS, BAG_TREES = 50, 10
#: Training rows of a task; each task of each level sends the sums of all its nodes, so many small ones cost more.
TASK_ROWS = 200_000


class LittleBags:
    """A forest in groups of trees, each group fitted on its own half of the rows.

    The spread between the groups' means, less what the few trees of a group leave of their own spread
    in it, is the variance of the forest's prediction. A group is one fit, so 500 trees take 50 fits, and
    new rows are scored in one pass, by arrays that hold the nodes of all trees. Halves follow from the row
    ids by hash.
    """

    def __init__(self, pipeline: PipelineModel, bags: int, trees: int, nodes: dict[str, np.ndarray]):
        self.pipeline, self.bags, self.trees, self.nodes = pipeline, bags, trees, nodes

    @property
    def leaves(self) -> list[np.ndarray]:
        """What each leaf predicts, tree by tree in the order of the leaves' numbers."""
        own = self.nodes["above"] == np.arange(len(self.nodes["above"]))
        parts = np.split(np.arange(len(own)), self.nodes["root"][1:])
        return [self.nodes["value"][at[own[at]]] for at in parts]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        label: str,
        predictors: Sequence[str],
        draws: Draws,
        row_id: str,
        mtry: int,
        min_n: int,
        bags: int = BAGS,
        trees: int = BAG_TREES,
        depth: int = DEPTH,
        parallelism: int = 4,
    ) -> LittleBags:
        spark = train.sparkSession
        # Scaling, count and halves read what the table holds without making it again.
        train = train.select(label, *predictors, row_id).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scaling = fit_scaling(train, predictors)
            halves = in_halves(scaling.transform(train).select("features", label, row_id), draws, row_id, bags)
            halves = halves.drop(row_id).coalesce(1 + train.count() // TASK_ROWS)
            halves = halves.persist(StorageLevel.MEMORY_AND_DISK)
            halves.count()
        finally:
            train.unpersist()

        def one_bag(g: int):
            group = forest(label, mtry, min_n, trees, seed=draws.seed + g, depth=depth)
            group.setPredictionCol(f"bag_{g}").setLeafCol(f"leaf_{g}")
            return group.fit(halves.where(F.col(f"half_{g}")))

        try:
            with ThreadPool(parallelism) as pool:
                models = pool.map(one_bag, range(bags), chunksize=1)
        finally:
            halves.unpersist()
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bags-{uuid.uuid4().hex}"
        pipeline = PipelineModel([*scaling.stages, *models])
        return cls(pipeline, bags, trees, cls._nodes(spark, pipeline, folder, bags))

    @staticmethod
    def _nodes(spark: SparkSession, pipeline: PipelineModel, folder: str, bags: int) -> dict[str, np.ndarray]:
        """All nodes, tree by tree in the order of their numbers: a part of the model.

        ``root`` is the first node of each tree; ``upto`` and ``above`` are where a value of ``feature`` up
        to or above ``threshold`` leads, in a leaf the node itself; ``value`` is what a node predicts.
        """
        save_model(pipeline, folder)
        nodes = spark.read.option("recursiveFileLookup", "true").schema(
            "treeID int, nodeData struct<id: int, prediction: double, leftChild: int, rightChild: int,"
            " split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"
        )
        first = len(pipeline.stages) - bags
        parts = [
            nodes.parquet(f"{folder}/stages/{_stage_name(pipeline, first + g)}/data").withColumn("bag", F.lit(g))
            for g in range(bags)
        ]
        # Scaled predictors are numbers, so that every split is a threshold.
        found = reduce(DataFrame.unionByName, parts).select(
            "bag", "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        ).toArrow().to_pandas().sort_values(["bag", "treeID", "id"], ignore_index=True)
        root = np.flatnonzero(found["id"].to_numpy() == 0)
        first = np.repeat(root, np.diff(np.append(root, len(found))))
        leaf = found["leftChild"].to_numpy() < 0
        own = np.arange(len(found))
        return {
            "root": root,
            "feature": np.where(leaf, 0, found["feature"].to_numpy()),
            "threshold": np.where(leaf, 0.0, found["threshold"].to_numpy()),
            "upto": np.where(leaf, own, first + found["leftChild"].to_numpy()),
            "above": np.where(leaf, own, first + found["rightChild"].to_numpy()),
            "value": found["prediction"].to_numpy(),
        }

    def predict(self, df: DataFrame, se_method: str = "bags") -> DataFrame:
        """Adds ``prediction`` and ``se``: ``bags`` as above, floored at 0; ``tree_sd`` the sd between trees."""
        scaling = PipelineModel(self.pipeline.stages[: len(self.pipeline.stages) - self.bags])
        scored = _bag_scores(df.sparkSession, self.bags, self.trees, self.nodes, se_method)
        scored = scaling.transform(df).withColumn("_s", scored(vector_to_array("features")))
        scored = scored.drop("raw_features", "features")
        return scored.withColumns({n: F.col(f"_s.{n}") for n in ("prediction", "se")}).drop("_s")

    def save(self, spark: SparkSession, path: str) -> str:
        save_model(self.pipeline, f"{path}/trees")
        spark.createDataFrame([(self.bags, self.trees)], "bags int, trees int").write.mode("overwrite").parquet(
            f"{path}/groups"
        )
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LittleBags:
        if not path_exists(spark, f"{path}/trees"):
            raise FileNotFoundError(path)
        row = spark.read.parquet(f"{path}/groups").first()
        pipeline = PipelineModel.load(f"{path}/trees")
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bags-{uuid.uuid4().hex}"
        return cls(pipeline, row.bags, row.trees, cls._nodes(spark, pipeline, folder, row.bags))


def _stage_name(pipeline: PipelineModel, at: int) -> str:
    """Folder of a stage in a saved pipeline."""
    width = len(str(len(pipeline.stages)))
    return f"{at:0{width}d}_{pipeline.stages[at].uid}"


def in_halves(df: DataFrame, draws: Draws, row_id: str, bags: int) -> DataFrame:
    """Whether each row is in the half of each group, columns ``half_0..``."""
    return df.withColumns({f"half_{g}": draws.uniform(f"half:{g}", row_id) < 0.5 for g in range(bags)})


def bag_variance(values: np.ndarray) -> np.ndarray:
    """Variance of the mean of ``values`` (rows x bags x trees), floored at 0."""
    trees = values.shape[2]
    means = values.mean(axis=2)
    between = means.var(axis=1)
    within = values.var(axis=2).mean(axis=1)
    return np.maximum(between - within / (trees - 1), 0.0) if trees > 1 else between


def reached(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of every tree (rows x trees) that the rows of ``x`` end in."""
    at = np.tile(nodes["root"], (len(x), 1))
    row = np.arange(len(x))[:, None] * x.shape[1]
    x = np.ascontiguousarray(x).ravel()
    while True:
        upto = x.take(row + nodes["feature"].take(at)) <= nodes["threshold"].take(at)
        to = np.where(upto, nodes["upto"].take(at), nodes["above"].take(at))
        if np.array_equal(to, at):
            return at
        at = to


#: Rows that are led through all trees at a time.
SCORED_ROWS = 512


def _bag_scores(spark: SparkSession, bags: int, trees: int, nodes: dict[str, np.ndarray], method: str):
    shared = spark.sparkContext.broadcast(nodes)

    @F.pandas_udf("prediction double, se double")
    def scores(features: pd.Series) -> pd.DataFrame:
        nodes = shared.value
        prediction, se = np.zeros(len(features)), np.zeros(len(features))
        for at in range(0, len(features), SCORED_ROWS):
            part = slice(at, at + SCORED_ROWS)
            found = nodes["value"].take(reached(nodes, np.stack(features.iloc[part].to_numpy())))
            values = found.reshape(len(found), bags, trees)
            # Summed in the order of the groups and their trees.
            prediction[part] = sum(sum(values[:, g, t] for t in range(trees)) / trees for g in range(bags)) / bags
            se[part] = found.std(axis=1, ddof=1) if method == "tree_sd" else np.sqrt(bag_variance(values))
        return pd.DataFrame({"prediction": prediction, "se": se})

    return scores


def in_bag_counts(df: DataFrame, draws: Draws, row_id: str, trees: int) -> DataFrame:
    """How often each row is in the bag of each tree, columns ``bag_0..``."""
    u = df.withColumns({f"_u_{b}": draws.uniform(f"bag:{b}", row_id) for b in range(trees)})
    counted = u.withColumns({f"bag_{b}": poisson_one(f"_u_{b}") for b in range(trees)})
    return counted.drop(*[f"_u_{b}" for b in range(trees)])


def in_bag_gram(counts: DataFrame) -> np.ndarray:
    """Sum over rows of ``bag bag'``: one matrix per task, then a sum per matrix row."""
    schema = "tree int, products array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                bag = column_values(batch, "bag")
                total = bag.T @ bag if total is None else total + bag.T @ bag
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))],
                names=["tree", "products"],
            )

    entries = counts.mapInArrow(run, schema).select("tree", F.posexplode("products"))
    sums = entries.groupBy("tree", "pos").agg(F.sum("col").alias("s"))
    # trees^2 numbers: metadata of the model, independent of the data size.
    rows = sums.collect()
    size = max(r["tree"] for r in rows) + 1
    gram = np.zeros((size, size))
    for r in rows:
        gram[r["tree"], r["pos"]] = r["s"]
    return gram


def _jackknife(gram: np.ndarray, n_train: int):
    trees = len(gram)

    @F.pandas_udf("double")
    def standard_error(t: pd.Series) -> pd.Series:
        values = np.stack(t.to_numpy()) if len(t) else np.zeros((0, trees))
        d = values - values.mean(axis=1, keepdims=True)
        raw = np.einsum("nb,nb->n", d @ gram, d) / trees**2
        bias = n_train / trees**2 * np.square(d).sum(axis=1)
        return pd.Series(np.sqrt(np.maximum(raw - bias, 0.0)))

    return standard_error


def predictive_draw(
    df: DataFrame, draws: Draws, prediction: str = "prediction", se: str = "se",
    seed_column: str = "parameter_seed",
) -> Column:
    """Normal(prediction, se) with the row's own seed: the same seed gives the same draw.

    A missing seed column is an error at once, a NaN standard error when the row is computed.
    """
    if seed_column not in df.columns:
        raise ValueError(f"column {seed_column!r} is required")
    checked = F.when(
        F.isnan(se), F.raise_error(F.lit("standard error is NaN: provide more new data"))
    ).otherwise(F.col(se))
    return F.col(prediction) + checked * draws.normal("predictive", seed_column)


def forecast_members(
    model: BaggedTrees | LittleBags, df: DataFrame, draws: Draws, se_method: str | None = None,
    seed_column: str = "parameter_seed", out: str = "y",
) -> DataFrame:
    """Ensemble forecast: scale, predict with standard error (by the model's own method by default), draw."""
    scored = model.predict(df, se_method) if se_method else model.predict(df)
    value = predictive_draw(scored, draws, seed_column=seed_column)
    return scored.withColumn(out, value).drop("prediction", "se")


def feature_array(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Scaled predictors as an array column."""
    return model.transform(df).withColumn("scaled", vector_to_array("features"))
