"""Intermediate tables in the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}

# Folders made inside open ``releasing`` blocks, innermost last.
_MADE: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local master (tests) may leave it unset; it then gets a scratch folder. A
    cluster without a shared folder is an error: executors can't read each other's disks.
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
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-llm-")
    return _LOCAL_FOLDERS[application]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; ``releasing`` removes it."""
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def releasing(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Remove the tables settled inside the block, but for those that ``kept`` holds at its end."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        files = [f for df in kept for f in df.inputFiles()]
        jvm = spark.sparkContext._jvm
        for path in made:
            if not any(f"{path.rsplit('/', 1)[-1]}/" in f for f in files):
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor costs at most the tasks that read it.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions: the salt count for keys that may be hot."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): every row as a struct, beside the columns that are read.

    Names made up on the way can't clash with columns of ``docs``; ``_row.*`` restores them.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
