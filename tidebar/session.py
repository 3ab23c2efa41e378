"""Sessions: how to start one, and how its executors get this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors through Spark's file server, once a session; Python workers can then import it."""
    context = spark.sparkContext
    if getattr(context, "_tidebar_shipped", False):
        return
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="tidebar-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(name)
    context._tidebar_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir, which the driver and all executors share, and read back: evaluated once, whatever executors are lost. Without that setting only
    a local session (tests) gets a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_tidebar_folder", None) or "file://" + tempfile.mkdtemp(prefix="tidebar-")
        spark.sparkContext._tidebar_folder = folder
    path = f"{folder}/tidebar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
