"""From delivered readings to trusted ones: remove repeats, check rules, put sensors on a common scale."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wearline.constants import MIN_WINDOW_READINGS, SENSORS, SILVER_WATERMARK


# Fixed size: 2^18 words of 64 bits. A million repeated keys make one of 17 other rows travel with them.
_WORDS = 2 ** 18


def dedup(readings: DataFrame, keys: Sequence[str] = ("event_id",), watermark: str = SILVER_WATERMARK) -> DataFrame:
    """One row per key. A stream keeps the first arrival and forgets a key once the watermark has passed it.

    A batch is read twice and has to give the same rows each time. Only a hash of the keys travels for every row; rows
    travel if their hash falls on the bit of a repeated one, the others stay where they are. Among those the partial
    aggregate runs before the shuffle, so a key with very many copies sends one row per task.
    """
    if readings.isStreaming:
        return readings.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
    key = F.xxhash64(*keys)
    hashes = readings.select(key.alias("_key")).repartition("_key")
    repeated = hashes.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    word, mask = F.pmod(F.shiftright("_key", 6), F.lit(_WORDS)), F.expr("shiftleft(1L, CAST(_key & 63 AS INT))")
    none = readings.sparkSession.range(0, _WORDS, 1, 1).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_mask"))
    words = none.union(repeated.select(word, mask)).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    # `_WORDS` numbers by construction, however many keys repeat: one value inside the plan.
    masks = words.agg(F.array_sort(F.collect_list(F.struct("_word", "_mask")))["_mask"]).scalar()
    marked = readings.withColumn("_key", key).withColumn("_mask", F.get(masks, word.cast("int")))
    maybe = F.expr("getbit(_mask, CAST(_key & 63 AS INT)) = 1")
    once = marked.where(~maybe).select(*readings.columns)
    more = marked.where(maybe).select(*readings.columns).dropDuplicates(list(keys))
    return once.unionByName(more)


@dataclass(frozen=True)
class Expectations:
    """Named boolean rules. A rule holds for a row only if it is TRUE; NULL counts as a failure."""

    rules: Mapping[str, str]

    def _holds(self, name: str) -> Column:
        return F.coalesce(F.expr(self.rules[name]), F.lit(False))

    def passed(self) -> Column:
        """TRUE for rows that satisfy every rule."""
        result = F.lit(True)
        for name in self.rules:
            result = result & self._holds(name)
        return result

    def drop(self, df: DataFrame) -> DataFrame:
        """Keep what satisfies every rule. A filter drops NULL by itself, and plain rules can reach the scan."""
        for rule in self.rules.values():
            df = df.filter(rule)
        return df

    def counters(self) -> list[Column]:
        return [
            counter
            for name in self.rules
            for counter in (
                F.count_if(self._holds(name)).alias(f"{name}__passed"),
                F.count_if(~self._holds(name)).alias(f"{name}__failed"),
            )
        ]

    def observe(self, df: DataFrame, name: str | Observation) -> DataFrame:
        """Count passes and failures as the rows flow by; no row is changed and no extra pass is made."""
        return df.observe(name, *self.counters())

    def summary(self, df: DataFrame, dataset: str) -> DataFrame:
        """(dataset, expectation, passed, failed), one row per rule, from one aggregate over the rows."""
        totals = df.agg(*self.counters())
        pairs = F.array(*[
            F.struct(
                F.lit(name).alias("expectation"),
                F.col(f"{name}__passed").alias("passed"),
                F.col(f"{name}__failed").alias("failed"),
            )
            for name in self.rules
        ])
        return totals.select(F.lit(dataset).alias("dataset"), F.inline(pairs))


# Rule names and bounds have to equal the published ones.
VALID_READING = Expectations({
    "valid_station": "station_id IS NOT NULL",
    "valid_ts": "ts IS NOT NULL",
    "vibration_in_range": "vibration_rms BETWEEN 0 AND 50",
    "temperature_in_range": "bearing_temp_c BETWEEN -20 AND 250",
    "current_in_range": "motor_current_a BETWEEN 0 AND 1000",
    "pressure_in_range": "hydraulic_pressure_bar BETWEEN 0 AND 400",
})
COMPLETE_WINDOW = Expectations({"complete_window": f"n_readings >= {MIN_WINDOW_READINGS}"})
WORK_ORDER_DOMAIN = Expectations({
    "known_priority": "priority IN ('P1', 'P2', 'P3')",
    "known_status": "status IN ('open', 'in_progress', 'completed', 'cancelled')",
})
COMMAND_DOMAIN = Expectations({
    "known_command": "command IN ('inject_fault', 'repair')",
    "known_status": "status IN ('pending', 'applied')",
})
# End of fixed values.


def not_from_future(now: str = "current_timestamp()") -> Expectations:
    """Warn-only rule: a reading may be at most one minute ahead of the clock `now` (a SQL expression)."""
    return Expectations({"not_from_future": f"ts <= {now} + INTERVAL 1 MINUTE"})


def with_nominals(readings: DataFrame, station_master: DataFrame) -> DataFrame:
    """Add `_nom_<sensor>`, the nominal value of a reading's station; unknown stations drop out.

    Plant and line come from the master, not from the message. The join carries no hint: Spark broadcasts the
    master while its size is under `spark.sql.autoBroadcastJoinThreshold` and shuffles beyond that.
    """
    described = ("plant_id", "line_id", "station_type", "criticality")
    reading, station = readings.alias("reading"), station_master.alias("station")
    columns = [F.col(f"reading.{c}") for c in readings.columns if c not in described]
    columns += [F.col(f"station.{c}") for c in described]
    columns += [F.col(f"station.nom_{sensor}").alias(f"_nom_{sensor}") for sensor in SENSORS]
    return reading.join(station, F.expr("reading.station_id = station.station_id")).select(columns)


def scaled(known: DataFrame) -> DataFrame:
    """`<sensor>_n`, the reading as a share of its nominal value, in place of the nominal values."""
    nominals = {f"_nom_{sensor}" for sensor in SENSORS}
    shares = [F.try_divide(sensor, f"_nom_{sensor}").alias(f"{sensor}_n") for sensor in SENSORS]
    return known.select(*[c for c in known.columns if c not in nominals], *shares)


def normalize(readings: DataFrame, station_master: DataFrame) -> DataFrame:
    """Readings of known stations on the common scale."""
    return scaled(with_nominals(readings, station_master))


def valid(readings: DataFrame, station_master: DataFrame, metrics: str | None = None) -> DataFrame:
    """Readings without repeats, of known stations and within the rules, with nominal values: the form to store.

    Scaled readings are as many random bits as the readings; nominal values repeat, so that next to nothing is written
    for them.
    """
    known = with_nominals(readings, station_master)
    if metrics:
        known = not_from_future().observe(known, f"{metrics}_warn")
        known = VALID_READING.observe(known, f"{metrics}_drop")
    return VALID_READING.drop(known)


def from_store(stored: DataFrame) -> DataFrame:
    """Silver out of its stored form; `silver_at` is the last column."""
    rows = scaled(stored)
    return rows.select(*[c for c in rows.columns if c != "silver_at"], "silver_at")


def trusted(readings: DataFrame, station_master: DataFrame, metrics: str | None = None) -> DataFrame:
    """Readings without repeats, on the common scale and within the rules."""
    return scaled(valid(readings, station_master, metrics))


def clean(readings: DataFrame, station_master: DataFrame, metrics: str | None = None) -> DataFrame:
    """Silver: repeats are removed first, so a bad first copy also removes its good repeat; rules apply after."""
    return trusted(dedup(readings), station_master, metrics)
