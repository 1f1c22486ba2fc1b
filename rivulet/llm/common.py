"""What several training-data operators share: scratch tables, column hygiene, text expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder of the session, which every executor can reach.

    Only a local session without ``spark.checkpoint.dir`` (a test) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rivulet-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared scratch folder and reads it back, which cuts the lineage."""
    return _written(df, scratch_dir(df.sparkSession))


class Scratch:
    """Tables that only last as long as the ``with`` block that makes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, scratch_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back."""
        self.made += 1
        return _written(df, f"{self.path}/{self.made}")

    def __exit__(self, *error) -> None:
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        free_shuffles(self.spark)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles nothing refers to any more; Spark then deletes their files on all executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the text ''."""
    as_text = F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit("")).cast("binary")) % modulus == remainder


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def keep_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows whose text passes, with all columns untouched. ``make`` builds a task's test of a list of texts (null as empty)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(np.asarray(test(texts), bool)))

    return docs.mapInArrow(run, docs.schema)
