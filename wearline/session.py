"""Session settings and the shared folder for checkpoints and intermediate tables."""

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.metricsEnabled": "true",
    # One state row per event id and per open window: too much for the JVM heap on a real fleet.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "wearline", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Shuffle files go with the execution that wrote them, instead of when the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def with_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings for what is started inside; the session has its own again afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def workspace(spark: SparkSession, *parts: str) -> str:
    """Folder of this application under the cluster's shared `spark.checkpoint.dir`.

    Only where that setting is absent (tests, a laptop) a local folder is used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wearline-")
        spark.sparkContext.setCheckpointDir(root)
    return "/".join([root.rstrip("/"), "wearline", spark.sparkContext.applicationId, *parts])


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for one run; nothing in it is shared with another run."""
    return workspace(spark, label, uuid.uuid4().hex)
