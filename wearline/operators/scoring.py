"""Turning window features into risk."""

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.constants import FEATURES, SENSORS, STATION_KEYS
from wearline.functions.columns import risk_band, scorecard, top_signal

Scorer = Callable[[DataFrame], DataFrame]


def by_scorecard(windows: DataFrame) -> DataFrame:
    return windows.withColumn("failure_probability", F.round(scorecard(), 4))


def by_model(model: Model) -> Scorer:
    """A fitted Spark ML pipeline; scoring stays in the JVM and works on streams as well. Probabilities are not rounded."""

    def score(windows: DataFrame) -> DataFrame:
        inputs = windows.withColumns({c: F.col(c).cast("double") for c in FEATURES})
        scored = model.transform(inputs)
        return scored.withColumn("failure_probability", vector_to_array("probability")[1]).select(*windows.columns, "failure_probability")

    return score


def risk_scores(
    windows: DataFrame,
    scorer: Scorer = by_scorecard,
    model_name: str = "scorecard",
    features_at: Column | None = None,
    scored_at: Column | None = None,
) -> DataFrame:
    """Gold rows: probability (four decimals), band and the signal to blame. Clocks default to the processing time."""
    stamped = windows.withColumn("features_at", F.current_timestamp() if features_at is None else features_at)
    signal, deviation = top_signal()
    scored = scorer(stamped).withColumn("failure_probability", F.round("failure_probability", 4))
    return scored.select(
        *STATION_KEYS, "window_start", "window_end", "last_reading_ts", "n_readings", "failure_probability",
        risk_band().alias("risk_band"), signal, deviation,
        *[f"avg_{s}" for s in SENSORS], *FEATURES,
        F.lit(model_name).alias("model_uri"), "features_at",
        (F.current_timestamp() if scored_at is None else scored_at).alias("scored_at"),
    )


def what_if(
    windows: DataFrame, scenarios: Sequence[tuple[str, float]], scorer: Scorer = by_scorecard
) -> DataFrame:
    """Every window under every scenario (sensor, change in percent): mean, max and min of that sensor move, its
    deviation does not."""
    unknown = {sensor for sensor, _ in scenarios} - set(SENSORS)
    if unknown:
        raise ValueError(f"unknown sensor: {', '.join(sorted(unknown))}")
    factor = 1 + F.col("change_pct") / 100
    base = scorer(windows).withColumnRenamed("failure_probability", "current_probability")
    cases = F.array(*[
        F.struct(F.lit(sensor).alias("sensor"), F.lit(float(change)).alias("change_pct"))
        for sensor, change in scenarios
    ])
    shifted = base.select("*", F.inline(cases)).withColumns({
        f"{s}_{stat}": F.when(F.col("sensor") == s, F.col(f"{s}_{stat}") * factor).otherwise(F.col(f"{s}_{stat}"))
        for s in SENSORS for stat in ("mean", "max", "min")
    })
    return scorer(shifted).withColumnRenamed("failure_probability", "scenario_probability")


def score_gap(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("station_id", "window_end")) -> DataFrame:
    """How far two scoring paths are apart, over the windows both of them scored."""
    pairs = left.select(*keys, F.col("failure_probability").alias("a")).join(
        right.select(*keys, F.col("failure_probability").alias("b")), list(keys))
    return pairs.agg(F.count(F.lit(1)).alias("windows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
