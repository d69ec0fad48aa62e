import pytest
from pyspark.sql import functions as F

from builders import at, rows, station_master
from wearline.plans import observability
from wearline.plans.maintenance import maintenance_events, maintenance_view
from wearline.sources.commits import sink_files, stream_commits
from wearline.sources.keyed_store import KeyedStore
from wearline.sources.storage import append_stream, read_stream
from wearline.streaming import flows

LOG = "event_id string, station_id string, event_ts timestamp, event_type string"


# -- the refreshed view ------------------------------------------------------------------------------------------

@pytest.fixture
def log(spark, tmp_path):
    class Log:
        folder = str(tmp_path / "log")
        schema = spark.createDataFrame([], LOG).schema

        def land(self, *events):
            made = [(e, s, at(60), "failure") for e, s in events]
            spark.createDataFrame(made, LOG).coalesce(1).write.mode("append").parquet(self.folder)

        def all(self):
            return spark.read.schema(self.schema).parquet(self.folder)

    return Log()


def same(view, log, master):
    want = maintenance_events(log.all(), master)
    return sorted(map(str, view.read().select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_refresh_reads_new_files_only(spark, tmp_path, log):
    master = station_master(spark, ("A", "P1", "P1-A", "press"), ("B", "P2", "P2-A", "robot_arm"))
    view = maintenance_view(spark, str(tmp_path / "view"))
    assert view.read() is None
    log.land(("1", "A"), ("2", "B"), ("3", "unknown"))
    first = view.refresh(log.folder, log.schema, master)
    assert (first.files, first.rebuilt) == (1, True) and same(view, log, master)
    opened = view.read()
    log.land(("4", "A"))
    log.land(("5", "B"), ("1", "A"))
    second = view.refresh(log.folder, log.schema, master)
    assert (second.files, second.rebuilt, second.version) == (2, False, first.version + 1) and same(view, log, master)
    assert opened.count() == 2 and view.read(first.version).count() == 2 and view.read().count() == 5
    assert view.refresh(log.folder, log.schema, master.orderBy(F.col("station_id").desc())) == type(second)(second.version, 0, False)


def test_a_changed_master_or_a_rewritten_file_rebuilds(spark, tmp_path, log):
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    view = maintenance_view(spark, str(tmp_path / "view"))
    log.land(("1", "A"), ("2", "B"))
    view.refresh(log.folder, log.schema, master)
    log.land(("3", "B"))
    wider = station_master(spark, ("A", "P7", "P1-A", "press"), ("B", "P2", "P2-A", "robot_arm"))
    done = view.refresh(log.folder, log.schema, wider)
    assert (done.files, done.rebuilt) == (2, True) and same(view, log, wider) and view.read().count() == 3
    spark.createDataFrame([("9", "A", at(1), "failure")], LOG).coalesce(1).write.mode("overwrite").parquet(log.folder)
    done = view.refresh(log.folder, log.schema, wider)
    assert (done.files, done.rebuilt) == (1, True) and rows(view.read(), "event_id") == [("9",)]


def test_a_refresh_cut_short_is_done_again(spark, tmp_path, log):
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    view = maintenance_view(spark, str(tmp_path / "view"))
    log.land(("1", "A"))
    view.refresh(log.folder, log.schema, master)
    log.land(("2", "A"))
    # The data of the next version are there, its manifest is not.
    spark.createDataFrame([("torn", "A", at(1), "failure")], LOG).write.parquet(view._data.path(1))
    assert rows(view.read(), "event_id") == [("1",)]
    assert view.refresh(log.folder, log.schema, master).files == 1
    assert rows(view.read(), "event_id") == [("1",), ("2",)]


def test_old_versions_go_and_what_is_still_used_stays(spark, tmp_path, log):
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    view = maintenance_view(spark, str(tmp_path / "view"))
    view.keep = 2
    for k in range(5):
        log.land((str(k), "A"))
        view.refresh(log.folder, log.schema, master)
    assert view._manifests.committed() == [3, 4] and view._data.there() == [0, 1, 2, 3, 4]
    view.refresh(log.folder, log.schema, station_master(spark, ("A", "P3", "P1-A", "press")))
    view.refresh(log.folder, log.schema, station_master(spark, ("A", "P4", "P1-A", "press")))
    assert view._data.there() == [5, 6] and view.read().count() == 5


# -- the keyed store ---------------------------------------------------------------------------------------------

def entries(spark, *made):
    return spark.createDataFrame([(k, at(t), p) for k, t, p in made], "k string, t timestamp, p double")


def test_keys_are_unique_across_batches_and_replays_change_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], ["t"], buckets=8)
    assert store.read() is None
    store.merge(entries(spark, *[(f"k{i}", 0, 0.0) for i in range(40)], ("k1", 5, 0.5)), 0)
    store.merge(entries(spark, ("k1", 3, 0.3), ("k2", 9, 0.9), ("new", 1, 0.1)), 1)
    want = {f"k{i}": 0.0 for i in range(40)} | {"k1": 0.5, "k2": 0.9, "new": 0.1}
    for _ in range(2):
        got = store.read().select("k", "p").collect()
        assert len(got) == 41 and dict(map(tuple, got)) == want
        store.merge(entries(spark, ("k1", 99, 9.9)), 1)  # a batch of that number is committed already
        store.merge(entries(spark, ("k1", 99, 9.9)), 0)
    assert store.versions() == [0, 1]
    store.merge(entries(spark), 2)
    assert store.read().count() == 41 and store.versions() == [0, 1, 2]


def test_only_touched_buckets_are_rewritten_and_readers_keep_their_version(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], ["t"], buckets=16, keep=2)
    store.merge(entries(spark, *[(f"k{i}", 0, 0.0) for i in range(400)]), 0)
    opened, before = store.read(), store.held(0)
    store.merge(entries(spark, ("k7", 1, 1.0)), 1)
    after = store.held(1)
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and after[changed[0]] == 1
    assert opened.count() == 400 and opened.agg(F.sum("p")).first()[0] == 0.0 and store.read().agg(F.sum("p")).first()[0] == 1.0
    written = spark.read.parquet(store._data.path(1)).count()
    assert 1 <= written < 80
    for version in (2, 3, 4):
        store.merge(entries(spark, ("k7", version, float(version))), version)
    assert store.versions() == [3, 4] and store.read().count() == 400
    assert store._data.there() == [0, 3, 4]  # untouched buckets still lie in the first one


def test_a_merge_cut_short_is_done_again(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], ["t"], buckets=4)
    store.merge(entries(spark, ("a", 0, 0.0)), 0)
    entries(spark, ("torn", 0, 0.0)).withColumn("_bucket", F.lit(1)).write.partitionBy("_bucket").parquet(store._data.path(1))
    assert rows(store.read(), "k") == [("a",)]
    store.merge(entries(spark, ("b", 0, 0.0)), 1)
    assert rows(store.read(), "k") == [("a",), ("b",)]


# -- commits of our own sinks ------------------------------------------------------------------------------------

def test_commits_agree_with_the_listener(spark, tmp_path):
    """More micro-batches than fit between two compactions of the sink's log."""
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(12):
        spark.range(k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), spark.range(1).schema, files_per_trigger=1)
    run = flows.run_available(spark, append_stream(flows._counted(stream, "many"), path, checkpoint, "many"))
    log = stream_commits(spark, path, checkpoint, "many", "someone")
    heard = {u["batchId"]: u["observedMetrics"]["many_written"]["written_rows"] for u in run.updates}
    assert {r.version: r.rows for r in log.collect()} == heard and len(heard) == 12
    assert sink_files(spark, path).agg(F.sum("bytes")).first()[0] > 0
    writers = observability.commit_writers(log).collect()
    assert [(r.user_name, r.writer, r.operation, r.commits) for r in writers] == [("someone", "many", "WRITE", 12)]
    assert observability.commit_cadence(log, 3600).first().commits == 12


def test_first_gap_reaches_back_before_the_window(spark):
    log = spark.createDataFrame(
        [("w", at(0)), ("w", at(100)), ("w", at(900)), ("w", at(1000)), ("one", at(990)), ("old", at(5)), ("n", at(950)), ("n", at(999))],
        "writer string, ts timestamp")
    got = observability.commit_cadence(log, 600, at(1000))
    assert rows(got, "writer", "commits", "avg_gap_s") == [("n", 2, 49.0), ("one", 1, None), ("w", 2, 450.0)]


def test_a_merge_moves_rows_once(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "once"), ["k"], ["v"], buckets=4)
    newest = store._newest(store._bucketed(spark.createDataFrame([(1, 1), (1, 3), (2, 2), (None, 5)], "k int, v int")))
    assert newest._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(newest, "k", "v") == [(1, 3), (2, 2), (None, 5)]
