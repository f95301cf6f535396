"""Structured Streaming variants of the transaction monitors (STM-01..04).

The reference loads its "event stream" as a batch file; these are re-aimed
streaming versions whose final state equals the batch computation:

* STM-01 ``read_transactions_stream`` / ``read_events_stream``: file
  streams with explicit schemas, event time from the data;
* STM-02 ``dedup_replays``: a replayed record (no id, so the key is a hash
  of the whole record) is dropped within the watermark;
* STM-03 ``structuring_windows``: sub-threshold transfers per client per
  sliding event-time window (7 days, sliding 1 day);
* STM-04 ``run_monthly_flows``: running monthly in / out / net per client as
  a log of parts, with the corrections that late rows make to closed months.

Aggregations run in *update* mode; ``run_available_now`` writes each
micro-batch's changed rows to a changelog table under the shared checkpoint
directory (``foreachBatch``) and ``latest`` keeps the newest version per
key — an upsert without a table format.  Stream checkpoints live in the same
shared directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions.dates import from_epoch_ms
from ..session import ensure_checkpoint_dir

# Fixed mapping of the test-data event kinds onto transaction types (ours).
EVENT_TXN_TYPE = {"purchase": "transfer_out", "signup": "transfer_in", "click": "buy", "view": "sell", "error": "fee"}
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_transactions_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """STM-01: bank B NDJSON transactions as a stream (event time ``value_ts``)."""
    r = spark.readStream.schema(S.BANK_B_TRANSACTIONS_JSON)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path).withColumn("value_ts", from_epoch_ms("valueDateMs"))


def _stream_path(path: str) -> str:
    """A file source watches a directory or a glob; a single file is given
    as a glob that matches only itself."""
    if os.path.isfile(path):
        d, n = os.path.split(path)
        return os.path.join(d, f"{n[:-1]}[{n[-1]}]")
    return path


def read_events_stream(spark: SparkSession, path: str) -> DataFrame:
    """STM-01 over the test-data ``events`` parquet."""
    return spark.readStream.schema(EVENTS_SCHEMA).parquet(_stream_path(path))


def events_as_transactions(df: DataFrame) -> DataFrame:
    """events → (client_key, txn_type, amount_usd, value_ts)."""
    from ..functions.text import map_lookup
    return df.select(F.col("user_id").alias("client_key"),
                     map_lookup("event_type", EVENT_TXN_TYPE, "unmapped").alias("txn_type"),
                     (F.col("value").cast("decimal(18,2)") * 100).cast("decimal(18,2)").alias("amount_usd"),
                     F.col("ts").cast("timestamp").alias("value_ts"))


def record_key(cols: list[str]) -> F.Column:
    """Hash of the whole record (the records carry no id)."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def dedup_replays(df: DataFrame, ts_col: str = "value_ts", delay: str = "2 days") -> DataFrame:
    """STM-02: drop replays of an identical record within the watermark."""
    return (df.withColumn("_rk", record_key(df.columns)).withWatermark(ts_col, delay)
            .dropDuplicatesWithinWatermark(["_rk"]).drop("_rk"))


def structuring_windows(tx: DataFrame, low: float = 8000, high: float = 9999,
                        types: tuple[str, ...] = ("transfer_out", "transfer_in"),
                        length: str = "7 days", slide: str = "1 day", delay: str | None = "2 days") -> DataFrame:
    """STM-03: count and sum of sub-threshold transfers per client and window.
    ``delay=None`` keeps a watermark defined upstream (e.g. by the dedup)."""
    t = tx.filter(F.col("txn_type").isin(*types) & F.col("amount_usd").between(low, high))
    if delay:
        t = t.withWatermark("value_ts", delay)
    return (t
            .groupBy(F.window("value_ts", length, slide).alias("w"), "client_key")
            .agg(F.count("*").alias("n"), F.sum("amount_usd").alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client_key", "n",
                    "total"))


def transactions_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """STM-01: the NDJSON stream as (client_key, txn_type, amount_usd, value_ts)."""
    from ..sources.raw import TXN_CODES, decode_join
    tx = decode_join(read_transactions_stream(spark, path, max_files), "txCode", TXN_CODES, "txn_type")
    return tx.select(F.col("cif").alias("client_key"), "txn_type", F.col("amount").cast("decimal(18,2)").alias("amount_usd"), "value_ts")


def write_transactions_feed(events: DataFrame, files: int) -> str:
    """The events as NDJSON transactions in ``files`` files of rising time under
    the shared checkpoint folder; returns the folder."""
    from ..functions.text import map_lookup
    from ..sources.raw import TXN_CODES
    codes = {kind: code for kind, txn in EVENT_TXN_TYPE.items() for code, name in TXN_CODES.items() if name == txn}
    path = os.path.join(ensure_checkpoint_dir(events.sparkSession), f"feed-{uuid.uuid4().hex}")
    rows = events.select(F.col("user_id").cast("string").alias("cif"), map_lookup("event_type", codes, "other").alias("txCode"),
                         (F.col("value").cast("decimal(18,2)") * 100).cast("double").alias("amount"), F.lit("USD").alias("ccy"),
                         F.unix_millis(F.col("ts").cast("timestamp")).alias("valueDateMs"), F.lit("EXT").alias("counterparty"), F.lit(None).cast("string").alias("fxLeg"))
    rows.repartitionByRange(files, "valueDateMs").write.json(path)
    return path


def monthly_flows(tx: DataFrame, inflow: tuple[str, ...] = ("transfer_in",),
                  outflow: tuple[str, ...] = ("transfer_out",)) -> DataFrame:
    """In / out / net per client and calendar month of the rows given."""
    zero = F.lit(0).cast("decimal(18,2)")
    return (tx.groupBy("client_key", F.date_trunc("month", "value_ts").alias("month"))
            .agg(F.sum(F.when(F.col("txn_type").isin(*inflow), F.col("amount_usd")).otherwise(zero)).alias("inflow_usd"),
                 F.sum(F.when(F.col("txn_type").isin(*outflow), F.col("amount_usd")).otherwise(zero)).alias("outflow_usd"),
                 F.max("value_ts").alias("newest"))
            .withColumn("net_usd", F.col("inflow_usd") - F.col("outflow_usd")))


def run_monthly_flows(tx: DataFrame, name: str, delay: str = "2 days", base: str | None = None) -> str:
    """STM-04: running monthly flows of a stream of transactions, without state.

    A micro-batch adds up its own rows and writes them as one part of a log,
    named by the batch, so that a batch that is run again replaces its part.
    Sums over the log (:func:`monthly_totals`) are the totals; no total is held
    by the stream, so what it needs does not grow with clients or months, and a
    row may come however late. The watermark, ``delay`` behind the newest row
    of earlier batches, closes the months that end before it: a part that
    changes such a month is marked as its ``correction``. ``base`` continues an
    earlier run. Returns the log's path."""
    spark = tx.sparkSession
    base = base or os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    log = os.path.join(base, "log")

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = monthly_flows(batch)
        earlier = spark.read.schema(MONTH_LOG).parquet(log).where(F.col("batch") < batch_id).agg(F.max("newest").alias("newest")) if _exists(spark, log) else None
        closed = earlier.select(F.expr(f"newest - INTERVAL {delay}")).first()[0] if earlier is not None else None
        late = F.coalesce(F.add_months("month", 1).cast("timestamp") <= F.lit(closed).cast("timestamp"), F.lit(False))
        parts.withColumn("correction", late).write.mode("overwrite").parquet(os.path.join(log, f"batch={batch_id}"))

    q = (tx.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return log


MONTH_LOG = ("client_key string, month timestamp, inflow_usd decimal(28,2), outflow_usd decimal(28,2), newest timestamp, net_usd decimal(29,2), "
             "correction boolean, batch int")


def monthly_totals(spark: SparkSession, log: str) -> DataFrame:
    """``client_key, month, inflow_usd, outflow_usd, net_usd, n_corrections``
    over all parts of a log."""
    if not _exists(spark, log):
        return spark.createDataFrame([], "client_key string, month timestamp, inflow_usd decimal(38,2), outflow_usd decimal(38,2), net_usd decimal(38,2), n_corrections long")
    parts = spark.read.schema(MONTH_LOG).parquet(log)
    return parts.groupBy("client_key", "month").agg(*(F.sum(c).alias(c) for c in ("inflow_usd", "outflow_usd", "net_usd")), F.count_if("correction").alias("n_corrections"))


def run_available_now(df: DataFrame, name: str, mode: str = "update") -> str:
    """Run a streaming DataFrame over all available input, then stop.

    Each micro-batch is appended (with its batch id) to a changelog table in
    the shared checkpoint directory; returns that table's path."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    base = os.path.join(root, "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out = os.path.join(base, "changelog")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, changelog: str, keys: list[str]) -> DataFrame:
    """Newest version of every key in a changelog (upsert view)."""
    if not _exists(spark, changelog):
        return None
    c = spark.read.parquet(changelog)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
