"""Files, read-only SQL sources, and writes that happen once."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# What a read-only statement looks like
_SINGLE = re.compile(r"^[^;]*;?\s*$")
_READ_ONLY = re.compile(r"^\s*(/\*[\s\S]*?\*/\s*)*(select|with|values|explain|show|pragma\s+table_info)\b", re.I)


def check_read_only(sql: str) -> str:
    if not _SINGLE.match(sql) or not _READ_ONLY.match(sql):
        raise ValueError("one SELECT, WITH or VALUES statement is accepted; pass literals as parameters")
    return sql.rstrip().rstrip(";")


def query_source(
    spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, max_rows: int = 1000, jdbc: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read-only parameterised query: (rows, one-row summary of rowCount and truncated).

    With ``jdbc`` options the statement runs in that database; otherwise over the
    session's own tables.  ``max_rows`` shortens the returned rows only.
    """
    text = check_read_only(sql)
    if jdbc is None:
        full = spark.sql(text, args=dict(params or {}))
    else:
        if params:
            raise ValueError("a JDBC source takes its parameters inside a prepared view, not here")
        full = spark.read.format("jdbc").options(**jdbc).option("query", text).load()
    n = max(max_rows, 1)
    summary = full.agg(F.count("*").alias("row_count")).withColumn("truncated", C("row_count") > n)
    return full.limit(n), summary


def plain_values(df: DataFrame) -> DataFrame:
    """Values as the connector shows them: times as ISO text, bytes as base64, unsafe whole numbers as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(f.name))
        elif kind == "binary":
            out.append(F.base64(f.name).alias(f.name))
        else:
            out.append(C(f.name))
    return df.select(*out)


def list_files(spark: SparkSession, path: str, recursive: bool = False, max_entries: int | None = None, glob: str = "*") -> DataFrame:
    """Files under a folder: path, type, size.  Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", F.lit("file").alias("type"), C("length").alias("size"))
    return files if max_entries is None else files.orderBy("path").limit(max_entries)


def read_files(spark: SparkSession, path: str, encoding: str = "utf8", recursive: bool = False, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """File contents as text or base64, with size and SHA-256."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    f = reader.load(path)
    if max_bytes is not None:
        too_big = F.raise_error(F.concat(F.lit("FILE_TOO_LARGE: "), C("path"))).cast("bigint")
        f = f.withColumn("length", F.when(C("length") <= max_bytes, C("length")).otherwise(too_big))
    content = F.base64("content") if encoding == "base64" else F.try_validate_utf8(C("content").cast("string"))
    return f.select("path", content.alias("content"), C("length").alias("size"), F.lit(encoding).alias("encoding"), F.sha2("content", 256).alias("sha256"))


def put_content(blobs: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Rows to write for a batch of contents: new ones, and erased ones that come back.

    ``blobs``: tenant_id, content, content_type, run_id.  ``stored``: tenant_id,
    hash, tombstoned_at.  Contents stored and alive are left out.
    """
    b = blobs.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("content", 256))).withColumn("size", F.octet_length("content"))
    b = b.groupBy("tenant_id", "hash").agg(F.min("size").cast("bigint").alias("size"), F.min("content_type").alias("content_type"), F.min("run_id").alias("run_id"))
    s = stored.groupBy("tenant_id", "hash").agg(F.bool_or(C("tombstoned_at").isNull()).alias("alive"))
    j = b.join(s, ["tenant_id", "hash"], "left").where("alive IS NULL OR NOT alive")
    return j.select("tenant_id", "hash", "size", "content_type", "run_id", now.alias("created_at"), C("alive").isNotNull().alias("revived"))


def apply_once(rows: DataFrame, applied: DataFrame, key: str = "idempotency_key", order: str = "seq") -> DataFrame:
    """Rows whose key was not applied before; of several with one key the first counts."""
    fresh = rows.join(applied.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r"))
    return first.select(key, "_r.*")


def once_writer(table: str, keys: str, key: str = "idempotency_key", order: str = "seq"):
    """``foreachBatch`` function that appends each key's first row to ``table`` and its key to ``keys``.

    Every micro-batch owns one folder in both, written whole and overwritten on
    retry, so a batch that ran twice leaves one result.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(key).schema.add("batch", "long")
        try:
            seen = spark.read.schema(schema).parquet(keys).where(C("batch") != number).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = batch.select(key).limit(0)
        fresh = apply_once(batch, seen, key, order)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        spark.read.parquet(f"{table}/batch={number}").select(key).write.mode("overwrite").parquet(f"{keys}/batch={number}")

    return write
