"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}

# Settings the jobs are written for. Shuffle width is left to AQE: start wide,
# let it coalesce. Dynamic partition overwrite makes a date rebuild touch one date.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key in a join even where that costs another shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keep hash aggregation for more groups per task before it falls back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def job_session(app_name: str = "storyloom", **settings: str) -> SparkSession:
    """Session for ``spark-submit`` runs; master and sizes come from the cluster."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**JOB_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def run_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master may leave it unset; it then gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-storyloom-")
    return _LOCAL_FOLDERS[application]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the written table.

    Used where a result must not change when the tables it was read from do,
    such as ids that are about to be written back to those tables. Later reads
    take only the columns they need.
    """
    path = f"{run_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates over the rows taken while they are written."""
    observation = Observation()
    table = cut(df.observe(observation, *[c.alias(name) for name, c in metrics.items()]))
    return table, observation.get
