import json

import pytest
from pyspark.sql import functions as F

from builders import at, reading, readings, rows, station_master
from conftest import SF
from wearline.constants import FEATURES, SENSORS
from wearline.operators.state import latest_per_key
from wearline.plans import observability
from wearline.plans.observability import rows_written
from wearline.schemas import SENSOR_READINGS
from wearline.sources.storage import VersionedTable, append_stream, overwrite, read_stream
from wearline.streaming import flows, progress, replay


class Small:
    """A site of hand-made readings."""

    def __init__(self, spark, *stations):
        self.spark, self.inputs = spark, "hand-made"
        self.master = station_master(spark, *(stations or [("P1-A01", "P1", "P1-A", "press")]))

    def raw(self, name):
        return self.master


def _steady(spark, seconds, station="P1-A01", **sensors):
    return readings(spark, [reading(station, s, **sensors) for s in seconds])


@pytest.fixture
def run(spark):
    return replay.start(Small(spark))


def test_repeats_in_the_same_and_in_the_next_batch(spark, run):
    run.land(readings(spark, [reading("P1-A01", 1), reading("P1-A01", 1), reading("P1-A01", 2, "bad", vibration_rms=99.0)]))
    run.clean()
    run.land(readings(spark, [reading("P1-A01", 1), reading("P1-A01", 2, "bad"), reading("P1-A01", 3)]))
    run.clean()
    # the good copy of "bad" came second, so its bad first copy has removed it
    assert rows(run.silver(), "event_id") == [("P1-A01-1",), ("P1-A01-3",)]


def test_late_readings_are_refused_and_counted(spark, run):
    run.land(_steady(spark, range(100)))
    run.clean()
    run.land(readings(spark, [reading("P1-A01", 5, "late"), reading("P1-A01", 75, "in-time")]))
    query = run.clean()
    assert progress.late_rows(query) == 1
    assert run.silver().filter("event_id IN ('late', 'in-time')").count() == 1


def test_window_is_emitted_when_the_watermark_reaches_its_end(spark, run):
    run.land(_steady(spark, range(131)))  # newest 130 s, delay 10 s: the window that ends at 120 s is due
    run.clean()
    run.score()
    assert rows(run.scores(), "window_end", "n_readings") == [(at(110), 110), (at(120), 120)]
    run.land(_steady(spark, range(131, 151)))
    run.clean()
    run.score()
    assert rows(run.scores(), "window_end") == [(at(110),), (at(120),), (at(130),), (at(140),)]


def test_streamed_scores_equal_batch_scores_after_restarts(spark, site):
    run = replay.start(site)
    for part in replay.sliced(site.raw("sensor_readings"), 3):
        run.land(part)
        run.clean()
        run.score()
        run.merge()
    streamed = run.scores()
    newest = site.table("readings_clean").agg(F.max("ts")).scalar()
    due = site.table("risk_scores").filter(F.col("window_end") <= newest - F.expr("INTERVAL 10 SECONDS"))
    same = ["station_id", "window_end", "n_readings", "failure_probability", "risk_band", "top_signal", *FEATURES,
            *[f"avg_{s}" for s in SENSORS]]  # bit for bit: nothing is rounded
    assert streamed.count() == due.count() > 0
    assert streamed.select(same).exceptAll(due.select(same)).isEmpty()
    current = run.current.read()
    expected = latest_per_key(due, ["station_id"], "window_end")
    assert rows(current, "station_id", "window_end", "failure_probability") == rows(
        expected, "station_id", "window_end", "failure_probability")


def test_no_new_data_changes_nothing(spark, run):
    run.land(_steady(spark, range(140)))
    for _ in range(2):
        run.clean()
        run.score()
        run.merge()
    assert run.silver().count() == 140 and run.scores().count() == 2 and run.current.read().count() == 1


def test_current_state_ignores_late_rows_and_replayed_batches(spark, tmp_path):
    def scores(*entries):
        return spark.createDataFrame([(s, at(e), at(e), p) for s, e, p in entries],
                                     "station_id string, window_end timestamp, scored_at timestamp, p double")

    table = VersionedTable(spark, str(tmp_path / "current"), keep=2)
    captured = {}

    class Writer:
        def queryName(self, _):
            return self

        def foreachBatch(self, fn):
            captured["fn"] = fn
            return self

        def option(self, *_):
            return self

    class Stream:
        writeStream = Writer()

    flows.station_health(Stream(), table, "unused")
    merge = captured["fn"]
    merge(scores(("A", 100, 0.1), ("A", 110, 0.2), ("B", 100, 0.3)), 0)
    merge(scores(("A", 90, 0.9), ("B", 120, 0.4)), 1)
    want = [("A", 0.2), ("B", 0.4)]
    assert rows(table.read(), "station_id", "p") == want
    merge(scores(("A", 90, 0.9), ("B", 120, 0.4)), 1)  # the same batch once more
    assert rows(table.read(), "station_id", "p") == want and table.versions() == [0, 1]
    assert rows(table.read(before=1), "station_id", "p") == [("A", 0.2), ("B", 0.3)]
    merge(scores(("C", 100, 0.5)), 2)
    assert table.versions() == [1, 2]


def test_a_half_written_version_is_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(spark.range(3), 0)
    broken = tmp_path / "t" / f"version={1:020d}"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"torn")
    assert table.read().count() == 3


def test_serving_copy_has_each_key_once(spark, run):
    run.land(_steady(spark, range(160)))
    run.clean()
    run.score()
    run.serve()
    run.serve()
    served = run.served()
    assert served.count() == served.select("station_id", "window_end").distinct().count() == run.scores().count()


def test_progress_log_counts_rules(spark, run):
    run.land(readings(spark, [*[reading("P1-A01", s) for s in range(140)], reading("P1-A01", 7, "hot", bearing_temp_c=999.0)]))
    done = [run.clean(), run.score()]
    path = f"{run.root}/events"
    for i, query in enumerate(done):
        progress.append_events(spark, path, query, f"u{i}")
    log = progress.read_events(spark, path)
    got = {r.expectation: (r.passed, r.failed) for r in observability.dq_rollup(log).collect()}
    assert got["temperature_in_range"] == (140, 1) and got["vibration_in_range"] == (141, 0)
    # newest reading 139 s, so windows up to 120 s are due: ten of them with too few readings
    assert got["complete_window"] == (2, 10) and got["not_from_future"][1] == 0
    newest = log.agg(F.max("timestamp")).first()[0]
    flows_ = {r.flow: r for r in observability.flow_rollup(log, seconds=3600, as_of=newest).collect()}
    assert flows_["readings_clean"].micro_batches >= 1 and flows_["readings_clean"].output_rows == 140
    assert flows_["risk_scores"].output_rows == run.scores().count() == 2
    assert json.loads(log.filter("flow_name = 'risk_scores'").first().details)["flow_progress"]["status"] == "COMPLETED"


def test_range_clustered_table_splits_a_hot_key(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a table this small is one file
    try:
        overwrite(df.repartition(6), str(tmp_path / "c"), cluster_by=("k", "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(str(tmp_path / "c"))
    files = stored.filter("k = 'hot'").groupBy(F.input_file_name().alias("f")).count()
    assert stored.count() == 3000 and files.count() > 1


def test_landing_schema_is_fixed(spark, run):
    run.land(_steady(spark, range(3)))
    assert set(spark.read.parquet(f"{run.root}/bronze").columns) == set(SENSOR_READINGS.fieldNames())


def test_no_update_of_a_long_run_is_lost(spark, tmp_path):
    """More micro-batches than Spark itself remembers."""
    for k in range(105):
        spark.range(k, k + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = read_stream(spark, str(tmp_path / "in"), spark.range(1).schema, files_per_trigger=1)
    run = flows.run_available(spark, append_stream(
        flows._counted(rows, "many"), str(tmp_path / "out"), str(tmp_path / "cp"), "many"))
    assert len(run.updates) >= 105 > len(run.query.recentProgress)
    progress.append_events(spark, str(tmp_path / "events"), run, "u")
    assert rows_written(progress.read_events(spark, str(tmp_path / "events"))).first().output_rows == 315


def test_model_queries_take_the_default_booster_and_the_stream_is_scored_by_it(spark, monkeypatch):
    from wearline import catalog
    from wearline.plans.site import Site, open_site
    from wearline.plans.training import BoostingParams
    from wearline.streaming import replay

    small, asked = open_site(spark, SF).model(BoostingParams(iterations=3, depth=3)), []
    monkeypatch.setattr(Site, "model", lambda self, params=BoostingParams(): asked.append(params) or small)
    monkeypatch.setattr(replay, "_RECORDINGS", {})
    for name in ("train_gbt", "score_gbt", "model_metrics_gbt", "lead_time_gbt"):
        catalog.queries()[name](spark, SF)
        assert asked and set(asked) == {BoostingParams()}
        asked.clear()
    gap = catalog.queries()["score_consistency"](spark, SF).first()
    assert gap.windows > 0 and gap.max_abs_diff == 0 and set(asked) == {BoostingParams()}
    streamed = replay.model_scores(open_site(spark, SF))
    assert {r.model_uri for r in streamed.select("model_uri").distinct().toLocalIterator()} == {"gbt"}


def test_a_recording_scores_slice_by_slice_and_holds_the_windows_of_one(spark, site):
    recording = replay.Recording(replay.start(site))
    stored = recording.scores()._stored_silver()
    assert len(recording.cleaned) == len(recording.scored) == replay.SLICES
    read = [sum(p["numInputRows"] for p in run.updates) for run in recording.scored]
    assert sum(read) == stored.count() and max(read) < stored.count() / 2  # before, one batch took in all of silver
    at_once = replay.Recording(recording.run, cleaned=recording.cleaned)
    at_once._score(lambda: recording.run.score("gold-at-once"))
    same = ["station_id", "window_end", "n_readings", "failure_probability", "top_signal", *FEATURES]
    gold, again = recording.run.scores().select(same), recording.run.scores("gold-at-once").select(same)
    assert gold.count() == again.count() > 0 and gold.exceptAll(again).isEmpty()


def test_silver_of_a_stream_stores_nominal_values_and_reads_as_scaled(spark, run):
    run.land(_steady(spark, range(5)))
    run.clean()
    assert "_nom_vibration_rms" in run._stored_silver().columns and "vibration_rms_n" not in run._stored_silver().columns
    scaled = run.silver()
    assert scaled.columns[-1] == "silver_at" and not [c for c in scaled.columns if c.startswith("_nom_")]
    assert scaled.where("vibration_rms_n IS NULL").isEmpty() and scaled.count() == 5


def test_shuffle_files_go_with_their_micro_batch_and_the_session_keeps_its_settings(spark, site):
    import os

    def shuffled():
        return sum(f.startswith("shuffle_") for d in dirs for _, _, files in os.walk(d) for f in files)

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dirs = [d.getPath() for d in manager.localDirs()]
    before, settings = shuffled(), {key: spark.conf.get(key, None) for key in flows._CONF}
    run = replay.start(site)
    run.land(site.raw("sensor_readings"))
    landed = shuffled()
    run.clean()
    run.score()
    assert run.scores().count() > 0 and shuffled() <= max(before, landed)  # before, they stayed
    assert {key: spark.conf.get(key, None) for key in flows._CONF} == settings


def test_rows_of_state_per_reading_are_not_counted_and_late_ones_still_are(spark, run):
    run.land(_steady(spark, range(100)))
    state = run.clean().updates[0]["stateOperators"][0]
    assert state["numRowsUpdated"] == 100 and state["numRowsTotal"] <= 0  # before, 100: a look-up more for every key
    run.land(readings(spark, [reading("P1-A01", 5, "late")]))
    assert progress.late_rows(run.clean()) == 1 and run.silver().count() == 100
    assert spark.conf.get(next(iter(flows.UNCOUNTED)), "true") == "true"
