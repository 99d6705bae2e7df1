"""Session settings the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foreunc", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; on a cluster pass no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of code beyond which the JVM doesn't compile a method but interprets it.
COMPILED_BYTES = 8_000


def compiled_stages(spark: SparkSession) -> None:
    """Let a stage whose generated method the JVM would only interpret run in smaller methods.

    Expressions of many draws or cells are that long; interpreted, a row costs several times as much.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > COMPILED_BYTES:
        spark.conf.set(key, str(COMPILED_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder; elsewhere a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        folder = configured
    elif context.getCheckpointDir():
        return context.getCheckpointDir()
    elif context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="foreunc-checkpoint-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later actions read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Later uses read it, whatever executors are lost, and the planner knows its size: it broadcasts
    the table in a join if that is below ``spark.sql.autoBroadcastJoinThreshold``, and else shuffles.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
