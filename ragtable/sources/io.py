"""Sources and sinks (S-01..S-08, S-17, S-18).

All readers take explicit schemas (no inference pass over the data) and keep
open-keyed metadata as ``map<string,string>``; ids come from the file name via
the ``_metadata`` column. Writers are plain DataFrame writes.
"""

from __future__ import annotations

import csv
import os
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nested_value, reformat_date

DOCUMENT_SCHEMA = "Dates map<string,string>, Misc map<string,string>, Classification map<string,string>, html string"
QA_SCHEMA = "source string, type string, question string, answer string"


def file_name():
    """Name of a row's file; the metadata column holds it URL-encoded (``+`` stands for itself there)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _stem(c):
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """S-01/S-04: one JSON document per ``*.json`` file; doc_key = file name, CELEX_ID = ID = stem."""
    df = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
          .select("*", file_name().alias("doc_key")))
    return df.withColumn("CELEX_ID", _stem(F.col("doc_key"))).withColumn("ID", F.col("CELEX_ID"))


def write_documents(df: DataFrame, path: str, drop_keys: Sequence[str] = ("html",), fmt: str = "parquet") -> None:
    """S-02: drop the configured columns (column pruning by hand in the source), then write."""
    df.drop(*drop_keys).write.mode("overwrite").format(fmt).save(path)


def load_chunks(df: DataFrame, content_key: str, mapping: dict[str, dict] | None = None) -> DataFrame:
    """S-03 + P-09: choose the text column and project metadata by a mapping.

    ``mapping``: name -> {"json_key": [path...], "type": "date"|"string"|"int"}. Paths walk
    map/struct columns; missing -> ''; 'date' values are reformatted dd/mm/yyyy -> yyyy-mm-dd.
    """
    cols = [F.coalesce(F.col(content_key), F.lit("")).alias("page_content")]
    for name, spec in (mapping or {}).items():
        path = spec["json_key"]
        if isinstance(path, str):
            raise TypeError(f"json_key of {name} must be a list")
        root, rest = path[0], path[1:]
        v = nested_value(F.col(root), rest) if rest else F.coalesce(F.col(root).cast("string"), F.lit(""))
        if spec.get("type") == "date":
            v = reformat_date(v)
        cols.append(v.alias(name))
    if mapping is None:
        cols += [F.col(c) for c in df.columns if c != content_key]
    return df.select(*cols)


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a CSV file, from its first line."""
    fs, at = _hadoop_path(spark, path)
    lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return tuple(next(csv.reader([(lines.readLine() or "").removeprefix("\ufeff")]), ()))
    finally:
        lines.close()


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """String columns whose values are all whole numbers become long, all numbers double; one pass decides for all columns."""
    if not columns:
        return df

    def fits(c, kind):
        return F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(kind).isNotNull())

    found = df.agg(*[fits(c, kind).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind in ("bigint", "double")],
                   *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    types = {c: next((k for k in ("bigint", "double") if found[f"{k}{i}"]), "string") for i, c in enumerate(columns) if found[f"n{i}"]}
    return df.select(*[F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in df.columns])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """S-05: one CSV per config (file stem = config); differing headers are unioned by name.

    Files of equal headers are one scan, and one pass over all files finds the numeric columns, so
    the number of jobs does not depend on the number of files. Columns without a value stay strings;
    files without a header line are skipped; a folder without any has no rows and only ``config``.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(f for f in list_folder(spark, path) if f.endswith(".csv")):
        names = _header(spark, os.path.join(path, f))
        if names:
            alike.setdefault(names, []).append(os.path.join(path, f))
    parts = [spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).csv(files)
             .select("*", _stem(file_name()).alias("config")) for names, files in alike.items()]
    if not parts:
        return spark.createDataFrame([], "config string")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _numbers(rows, [c for c in rows.columns if c != "config"])


def write_results(df: DataFrame, path: str) -> None:
    """S-05: one CSV folder per config."""
    df.write.mode("overwrite").partitionBy("config").option("header", True).csv(path)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """S-06: QA set CSV, quoted, header, multi-line fields."""
    return (spark.read.schema(QA_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))


def write_qa(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def conversation_log_lines(df: DataFrame, role: str = "role", content: str = "text") -> DataFrame:
    """S-07: one JSON object {"role", "content"} per message; non-ASCII kept as is."""
    return df.select(F.to_json(F.struct(F.col(role).alias("role"), F.col(content).alias("content"))).alias("value"))


def append_conversation_log(df: DataFrame, path: str, role: str = "role", content: str = "text") -> None:
    conversation_log_lines(df, role, content).write.mode("append").text(path)


def concat_documents(dfs: Sequence[DataFrame]) -> DataFrame:
    """S-18: records with differing fields -> one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """File names in a folder of any store that Spark reads."""
    fs, at = _hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)]


def index_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop_path(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(at)


def materialise_index(tables: dict[str, DataFrame], root: str, name: str, reuse: bool = True) -> dict[str, DataFrame]:
    """S-17: write each index table under ``root/name/<kind>`` unless a complete copy exists.

    An index made of several tables is complete only when every one has its
    ``_SUCCESS`` marker; otherwise all are (re)written.
    """
    spark = next(iter(tables.values())).sparkSession
    paths = {k: os.path.join(root, name, k) for k in tables}
    if not (reuse and all(index_exists(spark, p) for p in paths.values())):
        for k, df in tables.items():
            df.write.mode("overwrite").parquet(paths[k])
    return {k: spark.read.parquet(p) for k, p in paths.items()}
