"""Exports: audit lines, account documents, metric exposition, fan-out items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import iso

C = F.col


def audit_lines(events: DataFrame, verification: DataFrame, exported_at: Column) -> DataFrame:
    """The audit log as lines (tenant_id, seq, line): a header with the chain verdict, then one event per line."""
    chain = F.struct("ok", "checked", C("broken_at_seq").alias("brokenAtSeq"), "reason")
    head = F.to_json(F.struct(F.struct(C("tenant_id").alias("tenant"), iso(exported_at).alias("exportedAt"), chain.alias("chain")).alias("_meta")))
    header = verification.select("tenant_id", F.lit(0).cast("bigint").alias("seq"), head.alias("line"))
    body = events.select("tenant_id", "seq", F.to_json(F.struct(*[C(c) for c in events.columns])).alias("line"))
    return header.unionByName(body)


def write_lines(lines: DataFrame, path: str, order: Sequence[str], partitions: int | None = None) -> None:
    """One folder per tenant; its part files, read in name order, are the lines in order."""
    spread = ["tenant_id", *order]
    n = [partitions] if partitions else []
    ranged = lines.repartitionByRange(*n, *spread).sortWithinPartitions(*spread)
    ranged.select("tenant_id", "line").write.partitionBy("tenant_id").text(path)


def account_lines(tenants: DataFrame, users: DataFrame, settings: DataFrame, versions: DataFrame, runs: DataFrame, exported_at: Column) -> DataFrame:
    """Each tenant's whole account as one JSON document, cut into lines (tenant_id, o1, o2, o3, o4, line).

    The lines of a tenant in order are the document.  Nothing is collected per
    tenant: items of a list are separate rows, and only each list's first item
    leaves out the comma.  Secrets and hashes are not part of it.
    """
    def rows(df: DataFrame, o1: int, o2: Column | str, o3: int, o4: Column | str, body: Column, list_id: Column | None = None) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(
            "tenant_id", F.lit(o1).alias("o1"), lit(o2).cast("string").alias("o2"), F.lit(o3).alias("o3"), lit(o4).cast("string").alias("o4"),
            body.alias("body"), (F.lit(None).cast("string") if list_id is None else list_id).alias("list_id"))

    t = tenants.select(C("id").alias("tenant_id"), C("name").alias("t_name"), C("created_at").alias("t_created"))
    u, w, v, r = (x.join(t.select("tenant_id"), "tenant_id", "left_semi") for x in (users, settings, versions, runs))
    meta = F.to_json(F.struct(F.lit("account-export/1").alias("format"), iso(exported_at).alias("exportedAt"),
                              F.struct(C("tenant_id").alias("id"), C("t_name").alias("name"), iso(C("t_created")).alias("createdAt")).alias("workspace")))
    open_ = F.concat(F.substring(meta, F.lit(1), F.length(meta) - 1), F.lit(',"people":['))
    person = F.to_json(F.struct(*[C(c) for c in ("id", "email", "name", "roles", "created_at", "last_login_at") if c in users.columns]))
    setting = F.to_json(F.struct(C("name"), F.struct(*[C(c) for c in ("enabled", "killed", "stable_version", "canary_version", "canary_percent") if c in settings.columns]).alias("settings")))
    w_open = F.concat(F.substring(setting, F.lit(1), F.length(setting) - 1), F.lit(',"versions":['))
    version = F.to_json(F.struct(*[C(c) for c in ("version", "status", "published_by", "published_at", "manifest_text") if c in versions.columns]))
    run = F.to_json(F.struct(*[C(c) for c in ("id", "workflow_name", "workflow_version", "status", "dry_run", "trigger_type", "inputs", "outputs", "error", "created_at", "finished_at") if c in runs.columns]))
    parts = [
        rows(t, 0, "", 0, "", open_),
        rows(u, 1, C("id"), 0, "", person, F.lit("people")),
        rows(t, 2, "", 0, "", F.lit('],"workflows":[')),
        rows(w, 3, C("name"), 0, "", w_open, F.lit("workflows")),
        rows(v, 3, C("name"), 1, C("version"), version, F.concat(F.lit("versions/"), C("name"))),
        rows(w, 3, C("name"), 2, "", F.lit("]}")),
        rows(t, 4, "", 0, "", F.lit('],"runs":[')),
        rows(r, 5, C("id"), 0, "", run, F.lit("runs")),
        rows(t, 6, "", 0, "", F.lit("]}")),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    place = ["o2", "o3", "o4"]
    heads = lines.where("list_id IS NOT NULL").groupBy("tenant_id", "list_id").agg(F.min(F.struct(*place)).alias("h")).select(
        "tenant_id", "list_id", "h.*", F.lit("").alias("comma"))
    j = lines.join(heads, ["tenant_id", "list_id", *place], "left")
    comma = F.when(C("list_id").isNull(), "").otherwise(F.coalesce("comma", F.lit(",")))
    return j.select("tenant_id", "o1", *place, F.concat(comma, C("body")).alias("line"))


def _label(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def labels_text(labels: Column) -> Column:
    """A label map as ``a="x",b="y"``, names in order."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit('="'), _label(F.element_at(labels, k)), F.lit('"'))), ",")


def _number(v: Column) -> Column:
    safe = F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    return F.when((safe == F.floor(safe)) & (F.abs(safe) < 1e15), safe.cast("bigint").cast("string")).otherwise(safe.cast("string"))


def metric_lines(values: DataFrame, kind: str = "gauge", help_text: str = "") -> DataFrame:
    """Text exposition of counters or gauges: ``metric, labels (text), value`` rows to lines.

    Sorted by (metric, part, labels) the lines are the exposition.
    """
    shown = F.when(C("labels") == "", "").otherwise(F.concat(F.lit("{"), C("labels"), F.lit("}")))
    rows = values.select("metric", F.lit(2).alias("part"), "labels", F.concat(C("metric"), shown, F.lit(" "), _number(C("value"))).alias("line"))
    names = values.select("metric").distinct()
    help_ = names.select("metric", F.lit(0).alias("part"), F.lit("").alias("labels"), F.concat(F.lit("# HELP "), C("metric"), F.lit(" " + help_text)).alias("line"))
    type_ = names.select("metric", F.lit(1).alias("part"), F.lit("").alias("labels"), F.concat(F.lit("# TYPE "), C("metric"), F.lit(" " + kind)).alias("line"))
    return help_.unionByName(type_).unionByName(rows)


def histogram_lines(metric: str, histogram: DataFrame) -> DataFrame:
    """Bucket, sum and count lines of ``labels, le, bucket, sum, count`` rows (see ``aggregates.histogram``)."""
    sep = F.when(C("labels") == "", "").otherwise(",")
    wrap = F.when(C("labels") == "", "").otherwise(F.concat(F.lit("{"), C("labels"), F.lit("}")))
    bound = F.when(C("le") == "+Inf", float("inf")).otherwise(C("le").try_cast("double"))
    bucket = F.concat(F.lit(f"{metric}_bucket{{"), C("labels"), sep, F.lit('le="'), C("le"), F.lit('"} '), C("bucket").cast("string"))
    rows = histogram.select("labels", F.struct(F.lit(0).alias("part"), bound.alias("b")).alias("o"), bucket.alias("line"))
    last = histogram.where("le = '+Inf'")
    sums = last.select("labels", F.struct(F.lit(1).alias("part"), F.lit(0.0).alias("b")).alias("o"), F.concat(F.lit(f"{metric}_sum"), wrap, F.lit(" "), _number(C("sum"))).alias("line"))
    counts = last.select("labels", F.struct(F.lit(2).alias("part"), F.lit(0.0).alias("b")).alias("o"), F.concat(F.lit(f"{metric}_count"), wrap, F.lit(" "), C("count").cast("string")).alias("line"))
    return rows.unionByName(sums).unionByName(counts)


def map_items(df: DataFrame, items: str, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series], result: str = "string") -> DataFrame:
    """Run a user's function over every item of an array column; failures become rows, not job failures.

    ``fn`` gets a frame with ``keys, index, item`` and returns one value per row.
    When a batch fails it is retried in halves, so only the bad items fail.
    """
    flat = df.select(*keys, F.posexplode(items).alias("index", "item"))
    schema = T.StructType([*[flat.schema[k] for k in keys], T.StructField("index", T.IntegerType()), T.StructField("ok", T.BooleanType()),
                           *T.StructType.fromDDL(f"value {result}, message string").fields])

    def attempt(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            values, message = fn(pdf).to_numpy(), None
        except Exception as e:
            if len(pdf) > 1:
                half = len(pdf) // 2
                yield from attempt(pdf.iloc[:half])
                yield from attempt(pdf.iloc[half:])
                return
            values, message = None, str(e) or type(e).__name__
        yield pdf.drop(columns="item").assign(ok=message is None, value=values, message=message)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield from attempt(pdf)

    return flat.mapInPandas(run, schema)
