"""Starting streaming queries with their checkpoint and output in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ROCKSDB, cut_lineage, shared_dir


def run_available(stream: DataFrame, purpose: str, mode: str = "append", timeout: int | None = None, partitions: int | None = None) -> DataFrame:
    """Process everything the source holds now and return the result as a table.

    Append mode writes Parquet files exactly once.  Update mode writes each
    micro-batch to its own folder, overwriting it when the batch is retried, and
    adds the batch number, so the newest row of a key can be picked.  ``partitions``
    sets the number of state stores of this query; by default it is the session's number
    of shuffle partitions.  The session's settings are as before once the query has ended.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    out, state = f"{base}/out", f"{base}/checkpoint"
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(_batch_writer(out)).start()
    try:
        query.awaitTermination(timeout) if timeout is not None else query.awaitTermination()
        if query.isActive:
            query.stop()
            raise TimeoutError(f"stream {purpose} did not finish in {timeout} s")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


def run_each(stream: DataFrame, purpose: str, make: Callable[[str], Callable[[DataFrame, int], None]]) -> str:
    """Run a ``foreachBatch`` function over everything the source holds now; returns its folder in the shared one.

    ``make(folder)`` builds the function.
    """
    base = shared_dir(stream.sparkSession, purpose)
    query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(make(base)).start()
    query.awaitTermination()
    return base


def _batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def newest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key in an update-mode table."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def replayed(history: DataFrame, at: str, purpose: str, slices: int = 4, files: int = 1, closing: DataFrame | Sequence[DataFrame] | None = None) -> DataFrame:
    """History as a stream of several micro-batches: slices of equal length in time, oldest first, then each table of ``closing``.

    Each slice is written as ``files`` files, which is what a micro-batch reads.
    """
    spark = history.sparkSession
    history = cut_lineage(history, "history")
    lo, hi = history.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    folder = shared_dir(spark, purpose)
    part = F.lit(0) if lo is None else F.least(F.floor((F.unix_micros(at) - lo) * slices / (hi - lo + 1)), F.lit(slices - 1))
    for i in range(slices):
        mine = F.coalesce(part, F.lit(0)) == i
        history.where(mine).repartition(files).write.mode("append").parquet(folder)
    for last in [closing] if isinstance(closing, DataFrame) else closing or []:
        last.select(history.columns).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(history.schema).option("maxFilesPerTrigger", files).parquet(folder)
