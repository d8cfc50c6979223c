"""Readers of event data and writers of results."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.workers import with_code


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, separator: str = ",", multi: dict[str, str] | None = None, most: dict[str, int] | None = None, on_excess: str = "TRUNCATE") -> DataFrame:
    """Delimited rows. ``multi`` fields hold several values between their own separator.

    ``most`` bounds the characters of a field; beyond it the value is cut (TRUNCATE), the field emptied (DROP)
    or the row refused (FAIL).
    """
    df = spark.read.csv(path, schema=schema, header=header, sep=separator, multiLine=False)
    for name, n in (most or {}).items():
        over = F.length(name) > n
        new = {"TRUNCATE": F.substring(name, 1, n), "DROP": F.lit(None).cast("string"), "FAIL": F.raise_error(F.concat(F.lit(f"{name} is longer than {n}: "), F.substring(name, 1, 40))).cast("string")}[on_excess]
        df = df.withColumn(name, F.when(over, new).otherwise(F.col(name)))
    return df.withColumns({n: F.filter(F.transform(F.split(n, _escape(sep)), lambda x: F.trim(x)), lambda x: x != "") for n, sep in (multi or {}).items()})


def _escape(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def flatten_json(df: DataFrame, column: str, mode: str = "NORMAL", delimiter: str = ".", occurrence: str = "_") -> DataFrame:
    """Adds ``fields``: array of (name, value) of the JSON text in ``column``. Values are text; null ones are left out.

    SIMPLE takes the values at the root (and in its lists of values), NORMAL names values by their path,
    GROUPED by their own name followed by the path with the number of each occurrence, GROUPED_AND_NORMAL by
    both. Text that isn't a JSON object gives null.
    """
    @F.pandas_udf("array<struct<name:string,value:string>>")
    def flat(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _flatten_text(t, mode.upper(), delimiter, occurrence))

    return with_code(df).withColumn("fields", flat(F.col(column)))


def _flatten_text(text: str | None, mode: str, delimiter: str, occurrence: str) -> list | None:
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    out: list[dict[str, str]] = []

    def put(path: list[str], ctx: list[str], value: object) -> None:
        if value is None:
            return
        v = value if isinstance(value, str) else json.dumps(value)
        if mode in ("SIMPLE", "NORMAL"):
            out.append({"name": delimiter.join(path), "value": v})
        elif mode == "GROUPED":
            out.append({"name": delimiter.join([path[-1], *ctx]), "value": v})
        else:
            out.append({"name": delimiter.join(path) + delimiter + delimiter.join(ctx), "value": v})

    def walk(node: dict, path: list[str], ctx: list[str]) -> None:
        for k, v in node.items():
            items = v if isinstance(v, list) else [v]
            for i, x in enumerate(items):
                at = [*ctx, f"{k}{occurrence}{i}"]
                if isinstance(x, dict):
                    if mode != "SIMPLE":
                        walk(x, [*path, k], at)
                elif isinstance(x, list):
                    if mode != "SIMPLE":
                        walk({k: x}, path, ctx)
                else:
                    put([*path, k], at, x)

    walk(root, [], [])
    return out


def simple_fields(df: DataFrame, column: str) -> Column:
    """The root values of a JSON object as a map, without Python."""
    return F.from_json(F.col(column), "map<string,string>")


def read_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Records of text between a start and an end token, tokens included."""
    text = spark.read.text(path, wholetext=True)
    pattern = f"(?s)({re.escape(start)}.*?{re.escape(end)})"
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("record"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """key, value of Hadoop sequence files, as text; Spark has no other reader for them than one that makes rows one by one."""
    rows = spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), None if kv[1] is None else str(kv[1])))
    return spark.createDataFrame(rows, "key string, value string")


def read_lines(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Lines of at most ``most`` characters; longer ones are cut and marked."""
    return spark.read.text(path).select(F.substring("value", 1, most).alias("line"), (F.length("value") > most).alias("cut"))


def write_results(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A query's result as files."""
    w = df.write.mode(mode).format(form)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_table(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).saveAsTable(name)


def shard_id(day: Column, uid: Column, shards: int) -> Column:
    """``yyyyMMdd_N``: the day and a hash of the document over the day's shards."""
    return F.concat_ws("_", day, F.pmod(F.hash(uid), F.lit(shards)).cast("string"))


def event_fields(df: DataFrame, catalog_columns: list[str], keys: list[str]) -> DataFrame:
    """Documents as one row per field value: keys, field, value."""
    pairs = []
    for c in catalog_columns:
        values = F.col(c).cast("array<string>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))
        pairs.append(F.transform(values, lambda v: F.struct(F.lit(c.upper()).alias("field"), v.alias("value"))))
    rows = df.select(*keys, F.explode(F.flatten(F.filter(F.array(*pairs), lambda p: p.isNotNull()))).alias("p"))
    return rows.select(*keys, "p.field", "p.value").where("value is not null")


def read_with_errors(spark: SparkSession, path: str, schema: T.StructType, form: str = "csv", **options: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows) of lines of CSV or JSON: lines that don't fit the schema go to the second, with their file."""
    bad = "_corrupt"
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad} | options
    parsed = F.from_csv("value", full.toDDL(), how) if form == "csv" else F.from_json("value", full, how)
    rows = text.withColumn("r", parsed)
    return rows.where(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad), rows.where(F.col(f"r.{bad}").isNotNull()).select(F.col("value").alias("record"), "file")
