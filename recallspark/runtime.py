"""Shared folder, staged tables and checked small inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it; unset, one beside the warehouse tables."""
    folder = spark.conf.get(_CHECKPOINT_SETTING, None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return bool(fs.exists(hadoop_path))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.mkdirs(hadoop_path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the plans made inside; afterwards it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def move_files(spark: SparkSession, pattern: str, target: Callable[[PurePosixPath], str]) -> None:
    """Give the files of a pattern other names in the same file system. Their content is not read."""
    fs, hadoop_pattern = _file_system(spark, pattern)
    for status in fs.globStatus(hadoop_pattern):
        moved = spark._jvm.org.apache.hadoop.fs.Path(target(PurePosixPath(status.getPath().toString())))
        fs.rename(status.getPath(), moved)


class Stage:
    """Tables written between two jobs of one run, removed at its end or with the application.

    Every write has a folder of its own, so a stage may serve any number of calls.

    A written table freezes row numbers and model outputs, so a lost executor
    or a second read never sees other values, and later passes read only the
    columns they need.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        self._writes = 0
        fs, path = _file_system(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._writes += 1
        path = f"{self.root}/{name}-{self._writes}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Write and learn the number of rows in the same job."""
        seen = Observation()
        written = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        return written, seen.get["rows"]

    def close(self) -> None:
        fs, path = _file_system(self.spark, self.root)
        fs.delete(path, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def array_slices(df: DataFrame, order: list[Column], value: Column, rows_per_slice: int) -> list[Column]:
    """A small configured table as arrays, each a scalar subquery of bounded length.

    Rows that are equal in `order` must be equal altogether. Usually there is one
    slice. A longer table gives several, to be applied one after
    the other in `order`, so that no single array outgrows its bound.
    """
    n = df.count()
    if n <= rows_per_slice:
        slices = [df.select(*_ordered(order), value.alias("value"))] if n else []
    else:
        numbered = df.select(
            *_ordered(order),
            value.alias("value"),
            F.row_number().over(Window.orderBy(*order)).alias("_row"),
        )
        slices = [
            numbered.filter((F.col("_row") > low) & (F.col("_row") <= low + rows_per_slice))
            for low in range(0, n, rows_per_slice)
        ]
    keys = [f"_o{i}" for i in range(len(order))]
    return [
        part.agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*keys, "value"))), lambda item: item["value"]
            )
        ).scalar()
        for part in slices
    ]


def _ordered(order: list[Column]) -> list[Column]:
    return [key.alias(f"_o{i}") for i, key in enumerate(order)]
