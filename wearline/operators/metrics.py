"""Named dimensions and measures over one fact table, for DataFrames and, as table functions, for SQL."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricView:
    """Dimensions are row expressions, measures aggregate expressions, both in Spark SQL over the columns of the facts."""

    name: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, str]

    def _with_dimensions(self, source: DataFrame) -> DataFrame:
        return source.withColumns({n: F.expr(e) for n, e in self.dimensions.items() if n not in source.columns})

    def query(
        self,
        source: DataFrame,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | None = None,
    ) -> DataFrame:
        """`where` may name dimensions as well as columns of the source."""
        unknown = [n for n in (*by, *measures) if n not in self.dimensions and n not in self.measures]
        if unknown:
            raise KeyError(f"{self.name} has no {', '.join(unknown)}")
        rows = self._with_dimensions(source)
        if where is not None:
            rows = rows.filter(where)
        return rows.groupBy(*by).agg(*[F.expr(self.measures[m]).alias(m) for m in measures])

    def register(self, facts: DataFrame) -> str:
        """A temporary SQL table function `<name>_by(dimensions ARRAY<STRING>)` over the facts; gives its name.

        It returns a column for each dimension, NULL for those not asked for, and one for each measure. Constant
        arguments are folded, and measures that a query does not select are not computed: the plan is the one of
        `query`. No dimension (an empty array or NULL) gives the total, no row if there are no facts. A name that is no
        dimension is an error.
        """
        spark, view, function = facts.sparkSession, f"{self.name}_facts", f"{self.name}_by"
        rows = self._with_dimensions(facts)
        rows.createOrReplaceTempView(view)
        kinds = self.query(facts, list(self.measures), by=list(self.dimensions)).schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
        chosen = [f"IF(array_contains(dimensions, '{d}'), {d}, NULL) AS chosen_{d}" for d in self.dimensions]
        known = ", ".join(f"'{d}'" for d in self.dimensions)
        strange = f"array_except(coalesce(dimensions, array()), array({known}))"
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {function}(dimensions ARRAY<STRING>) RETURNS TABLE ({columns})
            RETURN SELECT {", ".join(f"chosen_{d}" for d in self.dimensions)}, {", ".join(self.measures.values())}
            FROM (SELECT *, {", ".join(chosen)} FROM {view}
                  WHERE size({strange}) = 0 OR raise_error(concat('{self.name} has no ', array_join({strange}, ', '))))
            GROUP BY {", ".join(f"chosen_{d}" for d in self.dimensions)}""")
        return function


def with_station(fact: DataFrame, station_master: DataFrame, *columns: str) -> DataFrame:
    """Left star join: facts of unknown stations stay, under NULL. Unhinted, so its size decides on a broadcast."""
    dimension = station_master.select("station_id", *[F.col(c).alias(f"station_{c}") for c in columns])
    return fact.join(dimension, "station_id", "left")


_CORRECTIVE = "event_type = 'corrective_repair'"
_PREVENTIVE = "event_type = 'preventive_repair'"

MAINTENANCE = MetricView(
    "maintenance",
    dimensions={
        "plant": "plant_name", "line": "line_id", "station": "station_id", "station_type": "station_type",
        "criticality": "criticality", "event_type": "event_type", "failure_mode": "failure_mode",
        "event_date": "event_date", "event_hour": "date_trunc('hour', event_ts)",
    },
    measures={
        "failures": "count_if(event_type = 'failure')",
        "corrective_repairs": f"count_if({_CORRECTIVE})",
        "preventive_repairs": f"count_if({_PREVENTIVE})",
        "downtime_min": "sum(downtime_min)",
        "parts_cost_usd": "sum(parts_cost_usd)",
        "mttr_min": f"avg(CASE WHEN {_CORRECTIVE} THEN downtime_min END)",
        "preventive_share": f"try_divide(count_if({_PREVENTIVE}), count_if({_CORRECTIVE} OR {_PREVENTIVE}))",
        "stations_with_failures": "count(DISTINCT CASE WHEN event_type = 'failure' THEN station_id END)",
    },
)

RISK = MetricView(
    "risk",
    dimensions={
        "plant": "station_plant_name", "line": "line_id", "station": "station_id", "station_type": "station_type",
        "criticality": "criticality", "risk_band": "risk_band", "top_signal": "top_signal",
        "score_minute": "date_trunc('minute', window_end)", "score_time": "window_end",
    },
    measures={
        "avg_failure_probability": "avg(failure_probability)",
        "max_failure_probability": "max(failure_probability)",
        "scored_windows": "count(1)",
        "high_risk_windows": "count_if(risk_band = 'HIGH')",
        "stations_at_high_risk": "count(DISTINCT CASE WHEN risk_band = 'HIGH' THEN station_id END)",
        "stations_down": "count(DISTINCT CASE WHEN risk_band = 'DOWN' THEN station_id END)",
        "latest_score_time": "max(window_end)",
        "avg_sensor_to_score_s": "avg(unix_millis(scored_at) - unix_millis(last_reading_ts)) / 1000.0D",
    },
)

WORK_ORDERS = MetricView(
    "work_orders",
    dimensions={
        "plant": "station_plant_name", "line": "line_id", "station": "station_id",
        "station_type": "station_station_type", "priority": "priority", "status": "status",
        "risk_band_at_creation": "risk_band", "top_signal_at_creation": "top_signal",
        "created_date": "to_date(created_at)",
    },
    measures={
        "work_orders": "count(1)",
        "open_work_orders": "count_if(status IN ('open', 'in_progress'))",
        "completed_work_orders": "count_if(status = 'completed')",
        "avg_risk_at_creation": "avg(failure_probability)",
        "avg_minutes_to_complete":
            "avg(CASE WHEN status = 'completed' THEN (unix_seconds(completed_at) - unix_seconds(created_at)) / 60.0D END)",
    },
)
