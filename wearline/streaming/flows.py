"""The streaming queries: trusted readings, risk scores, current state, changes by key. Each has its own watermark and
checkpoint."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wearline.constants import FRESH_S
from wearline.operators.clean import COMPLETE_WINDOW, dedup, scaled, valid
from wearline.operators.scoring import Scorer, by_scorecard, risk_scores
from wearline.operators.state import latest_per_key
from wearline.operators.windows import streamed_window_features
from wearline.session import FREED, with_settings
from wearline.sources.keyed_store import KeyedStore
from wearline.sources.storage import VersionedTable, append_stream
from wearline.streaming.keyed import merged_images, newest_images
from wearline.streaming.progress import WRITTEN, Run, follow
from pyspark.sql import functions as F


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """Rows as they are written: the file sink itself reports no count."""
    return rows.observe(f"{name}_written", F.count(F.lit(1)).alias(WRITTEN))


def readings_clean(
    bronze: DataFrame, station_master: DataFrame, path: str, checkpoint: str, silver_at: Column | None = None
) -> DataStreamWriter:
    """Silver in its stored form (`valid`): who reads it scales it by `from_store`."""
    silver = valid(dedup(bronze), station_master, metrics="readings_clean").withColumn(
        "silver_at", F.current_timestamp() if silver_at is None else silver_at)
    return append_stream(_counted(silver, "readings_clean"), path, checkpoint, "readings_clean")


def scored_windows(silver: DataFrame, scorer: Scorer = by_scorecard, model_name: str = "scorecard") -> DataFrame:
    """Windows of silver in its stored form are scored in the query that closes them; no table lies between."""
    windows = COMPLETE_WINDOW.observe(streamed_window_features(silver, scale=scaled), "risk_scores_drop")
    return risk_scores(COMPLETE_WINDOW.drop(windows), scorer, model_name)


def station_risk_scores(silver: DataFrame, path: str, checkpoint: str, **scoring) -> DataStreamWriter:
    scores = scored_windows(silver, **scoring)
    return append_stream(_counted(scores, "risk_scores"), path, checkpoint, "risk_scores")


def station_health(scores: DataFrame, current: VersionedTable, checkpoint: str) -> DataStreamWriter:
    """One row per station; a row that arrives late never replaces a newer one."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        previous = current.read(before=batch_id)
        rows = batch if previous is None else previous.unionByName(batch)
        current.write(latest_per_key(rows, ["station_id"], "window_end", "scored_at"), batch_id)

    return (
        scores.writeStream.queryName("health_current").foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
    )


def _by_batch(
    rows: DataFrame, path: str, checkpoint: str, name: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> DataStreamWriter:
    """One folder per batch id; a replayed batch replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id:020d}")

    return rows.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint)


def serving_copy(scores: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Score rows for a serving store, once per (station, window end); a replayed batch replaces its own folder."""
    return _by_batch(scores, path, checkpoint, "serving_copy", lambda batch: latest_per_key(
        batch, ["station_id", "window_end"], "scored_at"))


SERVED_KEYS, SERVED_ORDER = ("station_id", "window_end"), ("scored_at",)


def keyed_serving(scores: DataFrame, store: KeyedStore, checkpoint: str) -> DataStreamWriter:
    """Score rows for a serving store, once per (station, window end) whatever the batch they come with."""
    return scores.writeStream.queryName("keyed_serving").foreachBatch(store.merge).option("checkpointLocation", checkpoint)


HEALTH_ORDER = ("window_end", "scored_at")


def health_changes(scores: DataFrame, path: str, checkpoint: str, silent: str = f"{FRESH_S} seconds") -> DataStreamWriter:
    """Changes of the current row per station: only stations that a micro-batch scores, or that have fallen silent."""
    changes = newest_images(scores, "station_id", HEALTH_ORDER, silent=("window_end", silent))
    return append_stream(_counted(changes, "health_changes"), path, checkpoint, "health_changes")


ORDER_LOG = ("lsn", "changed_at")


def work_order_changes(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Live work orders out of a change log that comes in any order: images from before an update never count.

    Orders are many, and each has few images, so their state is an aggregate and not one Python object per key.
    """
    images = log.where(F.col("change_type").isin("insert", "update_postimage", "delete"))
    changes = merged_images(images, "work_order_id", ORDER_LOG, deleted=("change_type", "delete"))
    return _by_batch(changes, path, checkpoint, "work_order_changes").outputMode("update")


#: Of the session that a query starts in, which it copies. One state row per event id and per open window is too much for the
#: JVM heap on a real fleet, whoever made the session.
_CONF = FREED | {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: For queries with a row of state per reading: else every write and every removal looks its key up once more, only to keep
#: the number of rows of state in the query's metrics.
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def _start(spark: SparkSession, writer: DataStreamWriter, settings: Mapping[str, str] = {}) -> StreamingQuery:
    with with_settings(spark, _CONF | dict(settings)):
        return writer.start()


def run_available(spark: SparkSession, writer: DataStreamWriter, settings: Mapping[str, str] = {}) -> Run:
    """Process what has arrived, close what the watermark allows, and stop."""
    return follow(spark, lambda: _start(spark, writer.trigger(availableNow=True), settings)).close()


def run_continuously(spark: SparkSession, writer: DataStreamWriter, every: str = "5 seconds") -> Run:
    """A running query; its updates gather in the returned run while it goes on."""
    return follow(spark, lambda: _start(spark, writer.trigger(processingTime=every)))


def drain(spark: SparkSession, *writers: Callable[[], DataStreamWriter]) -> list[Run]:
    """Run dependent queries one after the other, each over everything the one before has written."""
    return [run_available(spark, build()) for build in writers]
