"""Explicit schemas: no table is ever read with an inferred one."""

from pyspark.sql import types as T

from wearline.constants import SENSORS

_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_SENSOR_FIELDS = [(s, _D) for s in SENSORS]

SENSOR_READINGS = _schema(
    ("event_id", _S), ("gateway_id", _S), ("plant_id", _S), ("line_id", _S), ("station_id", _S),
    ("ts", _TS), ("seq", _L), *_SENSOR_FIELDS, ("firmware", _S),
)
HISTORY_READINGS = _schema(
    ("station_id", _S), ("ts", _TS), *_SENSOR_FIELDS, ("ttf_s", _D), ("true_failure_mode", _S),
)
MAINTENANCE_LOG = _schema(
    ("event_id", _S), ("station_id", _S), ("event_ts", _TS), ("event_type", _S), ("failure_mode", _S),
    ("technician_id", _S), ("downtime_min", _D), ("parts_cost_usd", _D), ("source", _S),
)
WORK_ORDER_CHANGES = _schema(
    ("change_type", _S), ("lsn", _L), ("changed_at", _TS), ("work_order_id", _L), ("station_id", _S),
    ("plant_id", _S), ("line_id", _S), ("priority", _S), ("status", _S),
    ("failure_probability", T.DecimalType(5, 4)), ("risk_band", _S), ("top_signal", _S), ("description", _S),
    ("assigned_technician_id", _S), ("created_by", _S), ("created_at", _TS), ("updated_at", _TS),
    ("completed_at", _TS),
)
LINE_PROGRAMS = _schema(
    ("line_id", _S), ("customer", _S), ("vehicle_program", _S), ("part_family", _S),
    ("jis_buffer_min", _I), ("line_stop_charge_usd_per_min", _I), ("units_per_hour", _I),
)
PROCESS_STEPS = _schema(
    ("station_position", _I), ("station_type", _S), ("process_step", _S),
    ("critical_quality_characteristic", _S),
)
EXPECTATION_COUNTS = T.ArrayType(_schema(
    ("name", _S), ("dataset", _S), ("passed_records", _L), ("failed_records", _L),
))
EVENT_LOG = _schema(
    ("event_type", _S), ("timestamp", _TS), ("update_id", _S), ("flow_name", _S), ("details", _S),
)
