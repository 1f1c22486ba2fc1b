"""Cutting the lineage of iterated tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle. Spark guesses the size of exploded and compressed tables from their files, far too small, and would send such a side through the driver to all executors."""
    return df.hint("merge")


def _guess(df: DataFrame) -> float:
    """The bytes that Spark takes ``df`` to have; infinite beyond 10**308."""
    told = df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    return float(told.partition("sizeInBytes=")[2].split()[0])


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder (a temporary one only in a local session without one, as in tests), so a loop's plan doesn't grow.

    A checkpoint keeps the guess of its size, and that of a join is the product of both sides' guesses: in a loop that joins
    a table with itself the digits of this number double each round, until they fill the driver's memory. Such a guess is
    dropped with what else Spark knows of the plan.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rivulet-"))
    if _guess(df) == float("inf"):
        df = DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)
    return df.checkpoint()
