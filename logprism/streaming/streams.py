"""Scoring, windowed counts and de-duplication of log streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logprism.functions import features as fx
from logprism.functions import fixed
from logprism.functions.formats import parse_iso
from logprism.operators import registry
from logprism.operators.process import process_table
from logprism.plans.features import extract_features
from logprism.plans.scoring import score_features
from logprism.session import store
from logprism.sources import model_store
from logprism.sources.exports import RECORD_FIELDS
from logprism.sources.files import listing

#: State that is large or kept long lies on disk, sorted, and not in the executors' memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Features that need one record only, so that a stream can compute them.
STREAM_FEATURES = fx.TIME_FEATURES + fx.WIFI_FEATURES + fx.TEXT_FEATURES + ("log_level_numeric",)


def read_log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON-line device logs as they arrive in a folder."""
    reader = spark.readStream.schema(RECORD_FIELDS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("log_ts", parse_iso(F.col("timestamp")))


def record_features(logs: DataFrame, ts: str = "log_ts", message: str = "message",
                    level: str = "log_level") -> DataFrame:
    """The features of ``STREAM_FEATURES``; stateless, for streams and tables alike."""
    text = F.col(message)
    return logs.withColumns({
        **fx.time_features(F.col(ts)), **fx.wifi_features(text), **fx.text_features(text),
        "log_level_numeric": fx.level_number(F.col(level)),
    })


def stream_scores(logs: DataFrame, model: model_store.Model) -> DataFrame:
    """Score each record by a model fitted on ``STREAM_FEATURES``; keeps no state.

    Gaps are filled with the training medians, so the model must be fitted with
    ``all_medians``.
    """
    return score_features(record_features(logs), model, stats="training")


def stream_window_counts(logs: DataFrame, minutes: int, slide_minutes: int | None = None,
                         delay: str = "10 minutes", keys: Sequence[str] = (), ts: str = "log_ts",
                         message: str = "message") -> DataFrame:
    """Events, errors and connections per clock window; late rows are dropped.

    These windows lie on a clock grid.  They are not the trailing windows of
    each record, which look back from the record's own time.
    """
    slide = slide_minutes or minutes
    window = F.window(ts, f"{minutes} minutes", f"{slide} minutes")
    counted = logs.withWatermark(ts, delay).groupBy(window, *keys).agg(
        F.count("*").alias("events"),
        F.count_if(fx.mentions(F.col(message), fixed.FAILURE)).alias("errors"),
        F.count_if(fx.mentions(F.col(message), fixed.CONNECTED)).alias("connections"),
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, "events", "errors", "connections")


def stream_dedup(logs: DataFrame, delay: str = "10 minutes", ts: str = "log_ts",
                 fields: Sequence[str] = ("log_ts", "message", "process_name")) -> DataFrame:
    """First of the records that agree in all fields, within the watermark."""
    return logs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(fields))


def stream_first_records(logs: DataFrame, fields: Sequence[str] = ("timestamp", "message", "process_name")) -> DataFrame:
    """First of the records that agree in all fields, over everything the stream has ever read.

    The keys seen are kept without end, so they lie in the RocksDB store, on
    disk and sorted, with a checkpoint that a restart goes on from; a repeated
    batch gives the same rows.  The state grows with the number of different
    keys: give ``stream_dedup`` a watermark where repeats come soon.
    """
    logs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return logs.dropDuplicates(list(fields))


def stream_sessions(logs: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes", keys: Sequence[str] = ("process_name",),
                    ts: str = "log_ts", message: str = "message") -> DataFrame:
    """Runs of records of a key without a pause of ``gap``: start, end (last record plus the gap), counts.

    A session is given once the watermark has passed its end; rows behind the
    watermark are dropped.
    """
    window = F.session_window(ts, gap)
    counted = logs.withWatermark(ts, delay).groupBy(window, *keys).agg(
        F.count("*").alias("events"), F.count_if(fx.mentions(F.col(message), fixed.FAILURE)).alias("errors"),
        F.count_if(fx.mentions(F.col(message), fixed.CONNECTED)).alias("connections"))
    return counted.select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
        *keys, "events", "errors", "connections")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there into a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_scores(batch: DataFrame, number: int, model: model_store.Model, history: str,
                 processes: DataFrame) -> DataFrame:
    """Scores of a micro-batch with all features, as if its logs had come with those before them.

    The batch is kept in the ``history`` folder, by day and by its number.
    Trailing windows look back over the logs of earlier batches as far as the
    widest window reaches; only the folders of these days are listed and read,
    so older ones may be removed at any time (see :func:`expired_history`).
    Process features come from a table of the logs that the model was fitted
    on, and gaps are filled with its medians, so the model must be fitted with
    ``all_medians``.  Where logs arrive in the order of time, the scores do not
    depend on how they are cut into batches.

    For streams with keys, :func:`logprism.streaming.stateful.stream_feature_scores`
    keeps the windows in the state and needs no history.
    """
    spark = batch.sparkSession
    keyed = batch.withColumns({"day": F.to_date("log_ts"), "batch": F.lit(number).cast("long")})
    # a repeated batch has the same days, and replaces its own folders only
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(history))
    kept = store(batch, "batch")
    reach = F.make_dt_interval(mins=F.lit(max(fixed.WINDOWS.values())))
    span = kept.agg(F.min("log_ts").alias("first"), F.max("log_ts").alias("last")).filter("first is not null").select(
        "first", F.sequence(F.to_date(F.col("first") - reach), F.to_date("last")).alias("days")).first()
    both = kept.withColumn("_new", F.lit(True))
    if span is not None:
        days = ",".join(day.isoformat() for day in span["days"])
        schema = T.StructType([*batch.schema, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
        earlier = spark.read.option("basePath", history).schema(schema).parquet(f"{history}/day={{{days}}}")
        earlier = earlier.filter((F.col("batch") < number) & (F.col("log_ts") >= F.lit(span["first"]) - reach))
        both = both.unionByName(earlier.select(*kept.columns).withColumn("_new", F.lit(False)))
    features = extract_features(both, processes=processes).filter("_new").drop("_new")
    return score_features(features, model, stats="training")


def expired_history(spark: SparkSession, history: str, now: Column) -> DataFrame:
    """``day`` of the history folders that no window of a record from ``now`` on reaches.  Nothing is deleted."""
    reach = F.make_dt_interval(mins=F.lit(max(fixed.WINDOWS.values())))
    days = listing(spark, history, "*.parquet").select(
        F.to_date(F.nullif(F.regexp_extract("path", "/day=([0-9-]+)/", 1), F.lit(""))).alias("day")).distinct()
    return days.filter(F.col("day") < F.to_date(now - reach))


def score_with_reload(
    stream: DataFrame, root: str, path: str, checkpoint: str,
    score: Callable[[DataFrame, model_store.Model], DataFrame] | None = None,
    history: str | None = None, reference: DataFrame | None = None,
) -> None:
    """Score micro-batches with the newest deployed model, looked up for every batch.

    Each batch is written to its own folder, named by the batch number, so a
    repeated batch overwrites itself.  Without ``score`` all features are used
    (see :func:`batch_scores`): ``history`` is the folder that keeps the logs
    for the windows of later batches, ``reference`` the logs that the model was
    fitted on.
    """
    if score is None and (history is None or reference is None):
        raise ValueError("give a history folder and reference logs, or a score function that needs neither")
    processes = None if score else store(process_table(reference), "processes")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = registry.latest_model(
            model_store.read_registry(spark, root).select("version", "created_at", "status"), deployed=True).first()
        if row is None:
            raise RuntimeError(f"no deployed model below {root}")
        model = model_store.load_model(spark, root, row["version"])
        out = score(batch, model) if score else batch_scores(batch, number, model, history, processes)
        out.withColumn("model_version", F.lit(row["version"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
