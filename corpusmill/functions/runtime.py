"""Session helpers shared by the operators: table access, lineage cuts, size estimates."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once an application, so that tasks can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        folder = tempfile.mkdtemp(prefix="corpusmill-package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/corpusmill", "zip", _PACKAGE.parent, _PACKAGE.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``.

    A local folder of its own is set only where the session names none and runs in one
    process (tests); a cluster without the setting is an error, since a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, lineage cut.

    The shuffle files of the plan that led here are no longer needed; a collection of the
    driver's garbage lets Spark's cleaner delete them at once, not at its next round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    del df
    gc.collect()
    kept.sparkSession._jvm.System.gc()
    return kept


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans); runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def safe_double(col) -> "F.Column":
    """``try_cast`` to double: text that is no number becomes null."""
    return F.expr(f"try_cast({col} AS DOUBLE)")


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by contract; an error, never a cut, beyond ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise RuntimeError(f"{what}: more than {most} rows")
    return rows
