"""Tabular and line sources, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sievewright.operators.conform import id_sorted, select_existing

CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
CSV_OUT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
           "ignoreTrailingWhiteSpace": False}


def read_manifest(spark: SparkSession, path: str, schema: StructType | str | None = None, strings: bool = True,
                  multiline: bool = False) -> DataFrame:
    """CSV manifest.

    With `strings` every column is text and a blank stays ''; otherwise the schema
    types the columns and a blank is NULL. Files are split among tasks; quoted line
    breaks need `multiline`, which makes each file one task. Without a schema the header is read in
    a small job of its own.
    """
    reader = spark.read.options(**{**CSV, "multiLine": multiline})
    if strings:
        df = reader.csv(path) if schema is None else reader.schema(schema).csv(path)
        return df.na.fill("")
    if schema is None:
        raise ValueError("a typed manifest needs a schema")
    return reader.schema(schema).csv(path)


def require(df: DataFrame, required) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_tsv(spark: SparkSession, path: str, required=(), schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated text without quoting; fails on missing columns."""
    reader = spark.read.options(header=True, sep="\t", quote="")
    return require(reader.schema(schema).csv(path) if schema else reader.csv(path), required)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with an order that follows the file: file, block, position in the block."""
    return spark.read.text(path).select(
        F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("line_order"))


def read_keyed_text(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """`key rest` lines; lines without both parts are dropped, the last line of a key wins."""
    parts = _lines(spark, path).select(F.split("line", r"(?U)\s+", 2).alias("p"), "line_order") \
        .where(F.size("p") == 2)
    return parts.groupBy(F.col("p")[0].alias(key)).agg(F.max_by(F.col("p")[1], "line_order").alias(value))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """`utterance recording start end` lines with exactly four fields; the last line of an utterance wins."""
    parts = _lines(spark, path).select(F.split("line", r"(?U)\s+").alias("p"), "line_order").where(F.size("p") == 4)
    last = parts.groupBy(F.col("p")[0].alias("utt_id")).agg(F.max_by("p", "line_order").alias("p"))
    return last.select("utt_id", F.col("p")[1].alias("recording_id"), F.col("p")[2].cast("double").alias("start_time"),
                       F.col("p")[3].cast("double").alias("end_time"))


def scan_columns(spark: SparkSession, path: str, columns) -> DataFrame:
    """The wanted columns that exist; payload columns are never read."""
    return select_existing(spark.read.parquet(path), columns)


def write_manifest(df: DataFrame, path: str, order=None, identifier: str = "sample_id", fmt: str = "parquet",
                   mode: str = "errorifexists") -> None:
    """Stable column order, rows sorted by id across the written files."""
    ordered = id_sorted(select_existing(df, order or df.columns), identifier)
    if fmt == "csv":
        ordered.write.mode(mode).options(**CSV_OUT).csv(path)
    else:
        ordered.write.mode(mode).format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A tidy report as JSON lines."""
    df.write.mode(mode).json(path)


def report_document(df: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """A report of bounded size as one nested JSON text per `by`; keys in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))))
    return df.groupBy(by).agg(F.to_json(F.map_from_entries(entries)).alias("document"))
