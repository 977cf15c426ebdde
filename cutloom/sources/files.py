"""File sources and sinks: paths of any store that Spark reads, checked before a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from cutloom.sources.errors import CutloomError


class Source(Protocol):
    def validate(self, spark: SparkSession) -> None: ...
    def description(self) -> str: ...
    def read(self, spark: SparkSession) -> DataFrame: ...


class Sink(Protocol):
    def description(self) -> str: ...
    def write(self, df: DataFrame) -> None: ...


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class FileSource:
    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    def validate(self, spark: SparkSession) -> None:
        if not exists(spark, self.path):
            raise CutloomError(f"input doesn't exist: {self.path}")

    def description(self) -> str:
        return f"{self.format} files at {self.path}"

    def read(self, spark: SparkSession) -> DataFrame:
        self.validate(spark)
        return spark.read.format(self.format).options(**self.options).load(self.path)


@dataclass(frozen=True)
class FileSink:
    """Spark makes missing folders."""

    path: str
    format: str = "parquet"
    mode: str = "error"

    def description(self) -> str:
        return f"{self.format} files at {self.path}"

    def write(self, df: DataFrame) -> None:
        df.write.format(self.format).mode(self.mode).save(self.path)


@dataclass(frozen=True)
class DirectorySink:
    """A folder for each value of the partition columns: frames of clips, kinds of images."""

    path: str
    by: tuple[str, ...]
    format: str = "parquet"
    mode: str = "error"

    def description(self) -> str:
        return f"{self.format} files at {self.path} by {', '.join(self.by)}"

    def write(self, df: DataFrame) -> None:
        df.repartition(*self.by).write.format(self.format).mode(self.mode).partitionBy(*self.by).save(self.path)


@dataclass
class Runner:
    """A source, operations on its frames, and a sink: Runner(source, sink).run(lambda t: t.splice([...]).reverse())."""

    source: Source
    sink: Sink | None = None

    def stream(self, spark: SparkSession):
        from cutloom.operators.timeline import Timeline

        return Timeline(self.source.read(spark))

    def run(self, spark: SparkSession, operations) -> DataFrame:
        frames = operations(self.stream(spark)).frames
        if self.sink:
            self.sink.write(frames)
        return frames
