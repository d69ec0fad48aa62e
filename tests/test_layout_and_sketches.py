import random

import pytest
from pyspark.sql import functions as F

from builders import at
from wearline.operators import sketches
from wearline.plans import training
from wearline.sources import layout
from wearline.sources.storage import overwrite


def _ends(spark, seconds):
    return spark.createDataFrame([(at(s),) for s in seconds], "window_end timestamp")


@pytest.mark.parametrize("size, n", [(200, 60000), (sketches.SIZE, 60000), (200, 3)])
def test_merged_sketches_keep_the_rank_bound(spark, size, n):
    draw = random.Random(n)
    rows = spark.range(n).select(F.timestamp_seconds(
        F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(200 * 3600))).alias("window_end")).repartition(7)
    hours = sketches.hourly_sketches(rows, "window_end", size)
    assert hours.agg(F.sum("n")).first()[0] == n and hours.count() <= 200
    for share in (0.01, draw.random(), 0.75, 0.99):
        span = sketches.rank_span(rows, "window_end", sketches.split_second(hours, share, size)).first()
        assert span.below <= share + sketches.rank_error(size) and span.through >= share - sketches.rank_error(size)


def test_sketches_of_hours_that_came_one_after_the_other(spark):
    """An hour's sketch is made once; rows without a time and empty tables change nothing."""
    parts = [_ends(spark, range(h * 3600, h * 3600 + 3600, 60)) for h in range(4)]
    later = sketches.hourly_sketches(parts[0], "window_end")
    for part in parts[1:]:
        later = later.unionByName(sketches.hourly_sketches(part, "window_end"))
    later = later.unionByName(sketches.hourly_sketches(spark.createDataFrame([(None,)], "window_end timestamp"), "window_end"))
    everything = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    assert later.count() == 4
    cut = spark.range(1).select(sketches.split_second(later, 0.75)).first()[0]
    exact = everything.agg(F.percentile(F.unix_timestamp("window_end"), F.lit(0.75))).first()[0]
    assert abs(cut - exact) <= 60 + 4 * 3600 * sketches.rank_error()
    assert spark.range(1).select(sketches.split_second(later.limit(0), 0.75)).first()[0] is None
    train, test = training.time_split(everything, gap_s=600, sketches=later)
    assert train.agg(F.max(F.unix_timestamp("window_end"))).first()[0] < cut
    assert test.agg(F.min(F.unix_timestamp("window_end"))).first()[0] >= cut + 600


def test_the_split_does_not_read_the_features(spark, site):
    cut = spark.range(1).select(sketches.split_second(site.table("training_hours"), 0.75).alias("cut"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "sketch" in plan and "window_end" not in plan


# -- layout by two keys ------------------------------------------------------------------------------------------

def _readings(spark, hot=False):
    station = F.when(F.lit(hot) & (F.col("id") % 3 == 0), F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)))
    return spark.range(20000).select(F.format_string("site-%03d", station).alias("station_id"),
                                     F.timestamp_seconds(1704067200 + F.col("id")).alias("ts"), "id")


def _skipped(spark, path, station, second):
    spans = layout.file_spans(spark, path, "station_id", "ts")
    span = F.timestamp_seconds(F.lit(1704067200 + second)), F.timestamp_seconds(F.lit(1704067200 + second + 100))
    found = spans.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")).select(
        "files", "rows", layout.share_skipped(spans, "station_id", F.lit(station), F.lit(station)).alias("by_station"),
        layout.share_skipped(spans, "ts", *span).alias("by_time"))
    return found.first()


def test_both_filters_skip_most_files(spark, tmp_path):
    rows, path = _readings(spark), str(tmp_path / "z")
    layout.overwrite_by_curve(rows, path, "station_id", "ts", files=100)
    got = [_skipped(spark, path, f"site-{s:03d}", t) for s, t in ((0, 0), (17, 9000), (39, 19800))]
    assert all(g.rows == 20000 and g.files <= 100 and g.by_station >= 0.8 and g.by_time >= 0.8 for g in got), got
    assert spark.read.parquet(path).exceptAll(rows).isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        overwrite(rows.repartition(100), str(tmp_path / "plain"), cluster_by=("station_id", "ts"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plain = _skipped(spark, str(tmp_path / "plain"), "site-017", 9000)
    assert plain.by_time < 0.8  # one key alone does not do it


def test_a_station_with_a_third_of_all_rows_is_cut_by_time(spark, tmp_path):
    layout.overwrite_by_curve(_readings(spark, hot=True), str(tmp_path / "z"), "station_id", "ts", files=64)
    spans = layout.file_spans(spark, str(tmp_path / "z"), "station_id", "ts")
    assert spans.agg(F.max("rows")).first()[0] < 4 * 20000 / 64
    assert _skipped(spark, str(tmp_path / "z"), "site-012", 5000).by_time >= 0.7


def test_odd_rows_are_kept(spark, tmp_path):
    odd = spark.createDataFrame([(None, at(1)), ("", None), ("é" * 40, at(2)), ("a", at(3)), ("a", at(3)), (None, None)],
                                "station_id string, ts timestamp")
    for name, rows in (("odd", odd), ("one", odd.where("station_id = 'a'")), ("none", odd.limit(0))):
        layout.overwrite_by_curve(rows, str(tmp_path / name), "station_id", "ts", files=4, bits=3)
        stored = spark.read.schema(odd.schema).parquet(str(tmp_path / name))
        assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))


def test_the_curve_visits_every_cell_once_and_never_jumps(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    placed = cells.select("x", "y", layout.curve_place(F.col("x"), F.col("y"), 4).alias("place")).collect()
    way = sorted(placed, key=lambda r: r.place)
    assert [r.place for r in way] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(way, way[1:]))


def test_the_curve_is_followed_once_per_cell_and_not_per_row(spark, tmp_path, monkeypatch):
    followed, curve = [], layout.curve_place
    monkeypatch.setattr(layout, "curve_place", lambda x, y, bits: followed.append(str(x) + str(y)) or curve(x, y, bits))
    readings = spark.range(2000).select(
        F.concat(F.lit("S"), F.col("id") % 7).alias("station"), F.timestamp_seconds(F.col("id") / 7).alias("ts"))
    layout.overwrite_by_curve(readings, f"{tmp_path}/table", "station", "ts", files=16)
    assert followed and not any("_bucket" in arguments for arguments in followed)
    written = spark.read.parquet(f"{tmp_path}/table")
    assert written.columns == readings.columns and written.exceptAll(readings).isEmpty() and written.count() == 2000
