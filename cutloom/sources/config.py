"""Clip configuration: JSON and TOML documents to and from a clips DataFrame."""

from __future__ import annotations

import json
import tomllib
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.sources.errors import UnsupportedFileFormat

_PARAMS = "struct<segments:array<string>,period:string,fps:double,format:string,quality:int>"
DOCUMENT = f"struct<path:string,output_dir:string,clips:array<struct<name:string,description:string,operation:struct<type:string,params:{_PARAMS}>>>>"
_RANGE = "struct<start:double,`end`:double>"
_TYPED = DOCUMENT.replace("segments:array<string>", f"segments:array<{_RANGE}>")


def parse_range(text: Column) -> Column:
    """A range given as an object with start and end or as an array of the two."""
    pair = F.from_json(text, "array<double>")
    as_array = F.struct(F.get(pair, 0).alias("start"), F.get(pair, 1).alias("end"))
    return F.when(F.ltrim(text).startswith("["), as_array).otherwise(F.from_json(text, _RANGE))


def clips_from_json(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """A row for each clip of each document: path, output_dir, clip_ord, name, description, op_type, segments, period, fps, format, quality.

    Unknown keys are ignored; an operation's defaults are 25 frames a second and quality 2. A document that isn't JSON gives no clip.
    Where every clip has segments and all of them are whole objects, a document is parsed once, ranges included; any other is
    parsed again with its ranges as text, since they may be arrays. Each step is a column of its own, so that nothing is computed twice.
    """
    whole = F.forall("t.clips", lambda c: F.coalesce(F.forall(c["operation"]["params"]["segments"], lambda r: r["start"].isNotNull() & r["end"].isNotNull()), F.lit(False)))
    typed = documents.select(F.col(json_col).alias("json"), F.from_json(F.col(json_col), _TYPED).alias("t"))
    checked = typed.select("json", "t", (F.col("t.path").isNotNull() & F.coalesce(whole, F.lit(False))).alias("whole"))
    both = checked.select("t", "whole", F.when(~F.col("whole"), F.from_json("json", DOCUMENT)).alias("u"))

    def ranged(c: Column) -> Column:
        op, q = c["operation"], c["operation"]["params"]
        params = F.struct(F.transform(q["segments"], parse_range).alias("segments"), q["period"].alias("period"), q["fps"].alias("fps"), q["format"].alias("format"), q["quality"].alias("quality"))
        return F.struct(c["name"].alias("name"), c["description"].alias("description"), F.struct(op["type"].alias("type"), params.alias("params")).alias("operation"))

    pick = lambda of_typed, of_text: F.when(F.col("whole"), of_typed).otherwise(of_text)
    listed = both.select(*[pick(F.col(f"t.{k}"), F.col(f"u.{k}")).alias(k) for k in ("path", "output_dir")], pick(F.col("t.clips"), F.when(F.col("u.path").isNotNull(), F.transform("u.clips", ranged))).alias("cs"))
    clips = listed.select("path", "output_dir", F.posexplode_outer("cs").alias("clip_ord", "c")).filter("clip_ord is not null")
    p = "c.operation.params"
    seq = F.col("c.operation.type") == "sequentise"
    return clips.select(
        "path", "output_dir", "clip_ord", F.col("c.name").alias("name"), F.col("c.description").alias("description"), F.col("c.operation.type").alias("op_type"),
        F.col(f"{p}.segments").alias("segments"), parse_range(F.col(f"{p}.period")).alias("period"),
        F.when(seq, F.coalesce(f"{p}.fps", F.lit(25.0))).alias("fps"), F.col(f"{p}.format").alias("format"), F.when(seq, F.coalesce(f"{p}.quality", F.lit(2))).alias("quality"),
    )


def runnable(clips: DataFrame) -> DataFrame:
    """Clips without an operation are skipped."""
    return clips.filter("op_type is not null")


def clips_to_json(clips: DataFrame) -> DataFrame:
    """path, json: one document for each (path, output_dir), ranges as objects. A document is one row by definition."""
    params = F.struct("segments", "period", "fps", "format", "quality")
    op = F.when(F.col("op_type").isNotNull(), F.struct(F.col("op_type").alias("type"), params.alias("params")))
    listed = clips.groupBy("path", "output_dir").agg(F.sort_array(F.collect_list(F.struct("clip_ord", "name", "description", op.alias("operation")))).alias("c"))
    bare = F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["description"].alias("description"), c["operation"].alias("operation")))
    return listed.select("path", F.to_json(F.struct("path", "output_dir", bare.alias("clips"))).alias("json"))


def _toml_value(value: Column) -> Column:
    """A string as TOML writes it: a JSON string is one."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def clips_to_toml(clips: DataFrame) -> DataFrame:
    """path, toml: one document for each (path, output_dir), as clips_to_json has it. What is null is left out."""
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key} = "), value, F.lit("\n")))
    span = lambda r: F.concat(F.lit("{ start = "), r["start"].cast("string"), F.lit(", end = "), r["end"].cast("string"), F.lit(" }"))
    segments = F.concat(F.lit("["), F.array_join(F.transform("segments", span), ", "), F.lit("]"))
    text = lambda c: F.when(F.col(c).isNotNull(), _toml_value(F.col(c)))
    params = F.concat_ws("", line("segments", segments), line("period", F.when(F.col("period").isNotNull(), span(F.col("period")))), line("fps", F.col("fps").cast("string")), line("format", text("format")), line("quality", F.col("quality").cast("string")))
    op = F.when(F.col("op_type").isNotNull(), F.concat(F.lit("[clips.operation]\n"), line("type", text("op_type")), F.lit("[clips.operation.params]\n"), params))
    clip = F.concat_ws("", F.lit("\n[[clips]]\n"), line("name", text("name")), line("description", text("description")), op)
    listed = clips.groupBy("path", "output_dir").agg(F.array_sort(F.collect_list(F.struct("clip_ord", clip.alias("toml")))).alias("c"))
    return listed.select("path", F.concat_ws("", line("path", text("path")), line("output_dir", text("output_dir")), F.array_join(F.transform("c", lambda c: c["toml"]), "")).alias("toml"))


def clips_from_toml(documents: DataFrame, toml_col: str = "toml") -> DataFrame:
    """clips_from_json of TOML documents; one that isn't TOML gives no clip."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    out.append(json.dumps(tomllib.loads(text or ""), default=str))
                except tomllib.TOMLDecodeError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])

    return clips_from_json(documents.select(toml_col).mapInArrow(run, "json string"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a .json or .toml file, which Spark reads wherever it is."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".json", ".toml"):
        raise UnsupportedFileFormat(suffix)
    text = spark.read.text(path, wholetext=True)
    return clips_from_json(text, "value") if suffix == ".json" else clips_from_toml(text, "value")


def write_config(clips: DataFrame, path: str, kind: str = "json") -> None:
    """One JSON line, or one TOML text, for each document."""
    if kind not in ("json", "toml"):
        raise UnsupportedFileFormat(f".{kind}")
    made = clips_to_json(clips) if kind == "json" else clips_to_toml(clips)
    made.select(kind).write.text(path)
