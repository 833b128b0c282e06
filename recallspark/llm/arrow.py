"""Narrow Arrow passes over chosen columns, and the scratch tables between passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """Run a kernel that yields dicts of column values over the Arrow batches of each task."""

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(batches):
            arrays = [
                columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                for f in schema
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        _release()

    return df.mapInArrow(run, ddl)


def _release() -> None:
    """Give back what Arrow keeps for later: an idle worker beside a busy executor should be small."""
    pa.default_memory_pool().release_unused()


def rewrite_batches(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """The same columns, whatever their names, with each Arrow batch changed."""
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(change(batch).columns, schema=schema)
        _release()

    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, df.schema)


def scratch_root(spark: SparkSession) -> str:
    """A new folder in the shared place; it goes when the application ends.

    The place is spark.checkpoint.dir as the session names it; unset, a folder
    beside the warehouse tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    root = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


class Scratch:
    """Tables written once and read again: frozen values that survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.written = spark, scratch_root(spark), 0
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.root}/t{self.written}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more: all that was derived from them is written."""
        self._delete([(t, p) for t, p in self.paths if any(t is x for x in tables)])

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self._delete([(t, p) for t, p in self.paths if not any(t is x for x in tables)])

    def _delete(self, gone: list[tuple[DataFrame, str]]) -> None:
        for table, path in gone:
            hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
            self.paths = [(t, p) for t, p in self.paths if t is not table]


def row_key(id_column: str, text_column: str) -> list:
    """Two columns that tell rows apart; rows equal in both are interchangeable."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(F.col(id_column).isNull(), F.coalesce(F.col(text_column), F.lit(""))).alias("k2"),
    ]
