"""Files in and out. All paths go through Spark's readers and writers, so any store that Spark reaches will do."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import CsvParseOptions, CsvWriteOptions, TextError, YamlParseOptions
from ..functions import csv_model as C
from ..functions import json_model as J
from ..functions import yaml_model as Y
from ..functions.json import strict
from ..operators.csv_table import CsvTable

CSV_ROWS = "path string, row_index long, fields array<string>, code string, message string, line long"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line; the lines are split, so one file is read by many tasks."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv_files(spark: SparkSession, path: str, options: CsvParseOptions = CsvParseOptions()) -> DataFrame:
    """Rows of CSV files: (path, row_index, fields, code, message, line).

    A quote may span lines, so a file is read by one task, record by record. A
    broken file gives the records before the error and one row with its code.
    Bytes that are not UTF-8 are an error, or with ``validate_utf8`` off kept
    as surrogates.
    """
    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, i = [], 0
                try:
                    try:
                        text = data.decode("utf-8", "strict" if options.validate_utf8 else "replace")
                    except UnicodeDecodeError as e:
                        raise TextError("E_INVALID_UTF8", str(e.reason), e.start) from e
                    for i, fields in enumerate(C.records(text, options)):
                        rows.append((name, i, fields, None, None, None))
                        if len(rows) >= 4096:
                            yield _rows(rows)
                            rows = []
                    i += 1
                except TextError as e:
                    rows.append((name, None, None, e.code, e.message, e.line))
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, CSV_ROWS)


def _rows(rows):
    types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "row_index", "fields", "code", "message", "line"])


def read_csv(spark: SparkSession, path: str, options: CsvParseOptions = CsvParseOptions(), mode: str = "FAILFAST") -> CsvTable:
    """One CSV file as a table. DROPMALFORMED keeps the records before an error, FAILFAST raises when the rows are read."""
    found = read_csv_files(spark, path, options)
    if mode == "FAILFAST":
        found = found.withColumn("fields", F.when(F.col("code").isNotNull(), F.raise_error(F.concat_ws(": ", "code", "message"))).otherwise(F.col("fields")))
    else:
        found = found.where("code is null")
    table = CsvTable(found.select("row_index", "fields"), dup_mode=options.dialect.header_dup_mode, allow_irregular_rows=True)
    if not options.dialect.treat_first_row_as_header:
        return table
    out = table.set_header_row(True)
    C.header_map(list(out.header), options.dialect.header_dup_mode)
    return replace(out, dup_mode=options.dialect.header_dup_mode)


def read_csv_trusted(spark: SparkSession, path: str, header: list[str], **options) -> DataFrame:
    """The built-in reader for well-formed rectangular files: split, pushed down and pruned; empty cells are empty strings."""
    schema = ", ".join(f"`{h}` string" for h in header)
    df = spark.read.schema(schema).csv(path, multiLine=False, escape='"', nullValue="\0", emptyValue="", header=True, enforceSchema=True, **options)
    return df.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in header])


def read_yaml_files(spark: SparkSession, path: str, options: YamlParseOptions = YamlParseOptions()) -> DataFrame:
    """(path, doc_index, json, error) of every document of YAML files in UTF-8, UTF-16 or UTF-32."""
    def run(data):
        return [J.write(Y.to_json(d)) for d in Y.parse_all(Y.decoded(bytes(data)), options)]

    files = spark.read.format("binaryFile").load(path).select("path", strict("array<string>", run, "content").alias("r"))
    return files.select("path", F.posexplode_outer(F.col("r.value")).alias("doc_index", "json"), F.col("r.error").alias("error"))


def write_csv(table: CsvTable, path: str, options: CsvWriteOptions = CsvWriteOptions(), sort: bool = True) -> None:
    """Writes the table's lines as text; the commit protocol makes it all or nothing."""
    lines = table.lines(options)
    (lines.sort("row_index") if sort else lines).select("line").write.option("lineSep", options.newline).text(path)


def write_text(df: DataFrame, path: str, column: str = "text", newline: str = "\n") -> None:
    df.select(column).write.option("lineSep", newline).text(path)
