"""Logical input tables, each derived from the driver tables by one SQL text.

The texts stay inside the dialect that Spark and the checking engine share, so a check can prepend the very same
definition as a common table expression. The two places where the dialects part are the `{fan(n)}` row generator
and the names of the driver tables; both are filled in by `Dialect`.
"""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wearline.constants import NOMINAL, SENSORS, STATION_TYPES_BY_POSITION

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass(frozen=True)
class Dialect:
    """`table` names a driver table, `fan` a relation suffix that repeats each row for j = 0..n-1."""

    table: str
    fan: str

    def render(self, sql: str) -> str:
        sql = re.sub(r"\{fan\((\d+)\)\}", lambda m: self.fan.format(last=int(m[1]) - 1, n=m[1]), sql)
        return re.sub(r"\{(\w+)\}", lambda m: self.table.format(name=m[1]), sql)


def spark_dialect(sf_dir: str) -> Dialect:
    """Driver tables are read in place."""
    return Dialect(f"parquet.`{sf_dir}/{{name}}.parquet`", "LATERAL VIEW explode(sequence(0, {last})) fan AS j")


CHECK_DIALECT = Dialect("{name}", "CROSS JOIN unnest(range(0, {n})) AS fan(j)")


def _by_type(column: int) -> str:
    branches = " ".join(f"WHEN '{kind}' THEN {float(values[column])}e0" for kind, values in NOMINAL.items())
    return f"CASE station_type {branches} END"


_TYPE_OF_POSITION = " ".join(
    f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(STATION_TYPES_BY_POSITION, start=1)
)
_NOMINALS = ", ".join(f"{_by_type(i)} AS nom_{s}" for i, s in enumerate(SENSORS))

# Own values: a seeded noise share and generator multiplier per sensor. The divisor 99991 keeps noise off short
# decimals, so rounding never meets an exact tie.
_NOISE = {
    "vibration_rms": (1.0, 7919), "bearing_temp_c": (0.2, 6121), "motor_current_a": (0.4, 5077),
    "spindle_rpm": (0.1, 4001), "hydraulic_pressure_bar": (0.3, 3557), "acoustic_db": (0.2, 2861),
    "cycle_time_s": (0.3, 2203),
}
_SIGNATURE = {
    "vibration_rms": "CASE WHEN station_type IN ('cnc_mill', 'conveyor', 'robot_arm') THEN 3e0 * d * d ELSE 0e0 END",
    "bearing_temp_c": "CASE WHEN station_type = 'welder' THEN 5e-1 * d ELSE 0e0 END",
    "hydraulic_pressure_bar": "CASE WHEN station_type = 'press' THEN -35e-2 * d ELSE 0e0 END",
}
_WHILE_DOWN = {
    "spindle_rpm": "0e0", "motor_current_a": "nom_motor_current_a * 5e-2", "vibration_rms": "5e-2",
}


def _sensor(s: str) -> str:
    share, step = _NOISE[s]
    running = f"nom_{s} * (1e0 + {share}e0 * ((g * {step} % 9973) / 99991e0) + {_SIGNATURE.get(s, '0e0')})"
    down = _WHILE_DOWN.get(s)
    return (f"CASE WHEN is_down THEN {down} ELSE {running} END" if down else running) + f" AS {s}"


_SENSOR_LIST = ", ".join(SENSORS)
_START = "TIMESTAMP '2024-01-01 00:00:00'"

# name -> (fixture tables it reads, SQL)
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _table(name: str, reads: tuple[str, ...], sql: str) -> None:
    _TABLES[name] = (reads, sql)


_table("station_master", (), f"""
SELECT station_idx, concat(line_id, '0', position) AS station_id, plant_id, concat('Plant ', plant_no) AS plant_name,
       line_id, position, station_type,
       CASE WHEN station_idx * 7 % 10 < 3 THEN 'high' WHEN station_idx * 7 % 10 < 8 THEN 'medium' ELSE 'low' END
         AS criticality,
       2012 + station_idx * 5 % 13 AS install_year, concat('gw-', plant_id) AS gateway_id, {_NOMINALS}
FROM (
  SELECT station_idx, plant_no, position, concat('P', plant_no) AS plant_id,
         concat('P', plant_no, '-', substr('ABCD', CAST(line_no AS INT), 1)) AS line_id,
         CASE position {_TYPE_OF_POSITION} END AS station_type
  FROM (
    SELECT station_idx, CAST(floor(station_idx / 32) AS BIGINT) + 1 AS plant_no,
           CAST(floor(station_idx % 32 / 8) AS BIGINT) + 1 AS line_no, station_idx % 8 + 1 AS position
    FROM range(0, 96) AS r(station_idx)
  ) numbered
) named
""")

def _telemetry(keyed: str) -> str:
    """One reading per station and second, with faults still absent, for numbers g and copy_no of a subquery."""
    return f"""
SELECT g, sec, copy_no, phase, is_down, station_idx, station_id, plant_id, line_id, gateway_id, station_type,
       {_START} + INTERVAL '1' SECOND * sec AS ts, 1704067200 + sec AS seq,
       {", ".join(_sensor(s) for s in SENSORS)}
FROM (
  SELECT r.g, r.sec, r.copy_no, r.phase, m.*,
         CASE WHEN r.st % 7 = 3 THEN least(1e0, r.phase / 400e0) ELSE 0e0 END AS d,
         r.st % 21 = 3 AND r.phase >= 440 AS is_down
  FROM (
    SELECT g, copy_no, g % 96 AS st, CAST(floor(g / 96) AS BIGINT) AS sec,
           (CAST(floor(g / 96) AS BIGINT) + g % 96 * 37) % 600 AS phase
    FROM ({keyed}) keyed
  ) r JOIN station_master m ON m.station_idx = r.st
) shaped
"""


# copy_no 1 marks the second delivery of a reading.
_table("telemetry", ("station_master",), _telemetry("""
SELECT o_orderkey * 8 + j % 8 AS g, CASE WHEN j = 8 THEN 1 ELSE 0 END AS copy_no
FROM {orders} {fan(9)} WHERE j < 8 OR o_orderkey % 20 = 0"""))
# Four times as long: the later quarter of a history has to exceed the gap between training and test.
_table("long_telemetry", ("station_master",), _telemetry("""
SELECT o_orderkey * 32 + j AS g, 0 AS copy_no FROM {orders} {fan(32)}"""))

_VIBRATION = "CASE WHEN g % 503 = 7 THEN 99e0 ELSE vibration_rms END AS vibration_rms"
_TEMPERATURE = "CASE WHEN g % 1009 = 5 THEN NULL ELSE bearing_temp_c END AS bearing_temp_c"

_table("sensor_readings", ("telemetry",), f"""
SELECT concat(station_id, '-', seq) AS event_id, gateway_id, plant_id, line_id, station_id, ts, seq,
       {_VIBRATION}, {_TEMPERATURE}, {", ".join(SENSORS[2:])}, '1.0.0' AS firmware
FROM (
  SELECT g, gateway_id, plant_id, line_id, ts, seq, {_SENSOR_LIST},
         CASE WHEN g % 1511 = 11 THEN 'P9-Z09' ELSE station_id END AS station_id
  FROM telemetry
) faulty
""")

# Which failure mode belongs to a station type, here and in the maintenance log.
_table("history_readings", ("long_telemetry",), f"""
SELECT station_id, ts, {_SENSOR_LIST}, ttf_s,
       CASE WHEN ttf_s IS NULL THEN NULL WHEN station_type = 'press' THEN 'seal_leak'
            WHEN station_type = 'welder' THEN 'overheating' ELSE 'bearing_wear' END AS true_failure_mode
FROM (
  SELECT *, CASE WHEN is_down THEN 0e0 WHEN station_idx % 7 = 3 AND phase < 400 THEN CAST(400 - phase AS DOUBLE) END
           AS ttf_s
  FROM long_telemetry
) aged
""")

_table("maintenance_log", ("station_master",), """
SELECT concat('H-', l_orderkey, '-', l_linenumber, '-', l_partkey) AS event_id,
       CASE WHEN l_partkey % 997 = 1 THEN 'P9-Z09' ELSE station_id END AS station_id,
       CAST(l_shipdate AS TIMESTAMP) AS event_ts,
       CASE l_returnflag WHEN 'N' THEN 'failure' WHEN 'R' THEN 'corrective_repair' ELSE 'preventive_repair' END
         AS event_type,
       CASE WHEN station_type = 'press' THEN 'seal_leak' WHEN station_type = 'welder' THEN 'overheating'
            WHEN station_type = 'conveyor' OR l_partkey % 2 = 0 THEN 'bearing_wear' ELSE 'overheating' END
         AS failure_mode,
       CASE WHEN l_returnflag <> 'N' THEN concat('T', l_suppkey) END AS technician_id,
       CASE l_returnflag WHEN 'N' THEN 0e0 WHEN 'R' THEN 45e0 + 27e-1 * l_quantity + (l_partkey % 97) / 99991e0
                         ELSE 15e0 + l_quantity / 2e0 + (l_partkey % 97) / 99991e0 END AS downtime_min,
       CASE l_returnflag WHEN 'N' THEN 0e0 ELSE l_extendedprice + (l_partkey % 89) / 99991e0 END AS parts_cost_usd,
       CASE WHEN l_suppkey % 10 = 0 THEN 'app' ELSE 'history' END AS source
FROM {lineitem} JOIN station_master ON station_idx = (l_orderkey * 7 + l_linenumber) % 96
""")

_table("technicians", (), """
SELECT concat('T', s_suppkey) AS technician_id, s_name AS full_name, concat('P', 1 + s_suppkey % 3) AS home_plant_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'electrical' ELSE 'hydraulics' END AS skill,
       concat('tech', s_suppkey, '@example.test') AS email, concat('+1-555-', 1000 + s_suppkey) AS phone
FROM {supplier}
""")

# insert -> update (image before and after, same log position) -> delete, one log per order.
_table("work_order_changes", ("station_master",), """
SELECT change_type, lsn, created_at + INTERVAL '1' MINUTE * step AS changed_at, work_order_id,
       CASE WHEN custkey % 389 = 7 THEN 'P9-Z09' ELSE station_id END AS station_id, plant_id, line_id, priority,
       CASE WHEN step = 0 OR change_type = 'update_preimage' THEN 'open' ELSE final_status END AS status,
       failure_probability,
       CASE WHEN failure_probability >= 0.7 THEN 'HIGH' WHEN failure_probability >= 0.4 THEN 'ELEVATED'
            ELSE 'NORMAL' END AS risk_band,
       CASE custkey % 3 WHEN 0 THEN 'vibration_rms' WHEN 1 THEN 'bearing_temp_c' ELSE 'hydraulic_pressure_bar' END
         AS top_signal,
       CASE WHEN work_order_id % 11 = 0 THEN '' ELSE concat('order ', work_order_id) END AS description,
       CASE WHEN step > 0 THEN concat('T', custkey % 100) END AS assigned_technician_id,
       concat('user-', custkey % 50) AS created_by, created_at,
       created_at + INTERVAL '1' MINUTE * step AS updated_at,
       CASE WHEN step > 0 AND change_type <> 'update_preimage' AND final_status = 'completed'
            THEN created_at + INTERVAL '1' MINUTE * (custkey % 600) END AS completed_at
FROM (
  SELECT o_orderkey AS work_order_id, o_custkey AS custkey, CAST(o_orderdate AS TIMESTAMP) AS created_at,
         o_orderkey * 10 + CASE j WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS lsn,
         CASE j WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS step,
         CASE j WHEN 0 THEN 'insert' WHEN 1 THEN 'update_preimage' WHEN 2 THEN 'update_postimage' ELSE 'delete' END
           AS change_type,
         CASE WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderkey % 37 = 0 THEN 'cancelled'
              ELSE 'completed' END AS final_status,
         CAST(o_totalprice / 500000e0 AS DECIMAL(5, 4)) AS failure_probability,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P1' WHEN '2' THEN 'P1' WHEN '3' THEN 'P2' ELSE 'P3' END
           AS priority,
         m.station_id, m.plant_id, m.line_id
  FROM (
    SELECT * FROM {orders} {fan(4)}
    WHERE j = 0 OR (j < 3 AND o_orderstatus <> 'O') OR (j = 3 AND o_orderkey % 50 = 0)
  ) o JOIN station_master m ON m.station_idx = o.o_custkey % 96
) changes
""")

# Orders that an operator asks for and later reports done; both refer to stations of the master or to unknown ones.
_table("work_order_requests", ("station_master",), """
SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 97 = 5 THEN 'P9-Z09' ELSE station_id END AS station_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P1' WHEN '2' THEN 'P2' WHEN '3' THEN 'P3' WHEN '4' THEN NULL
            ELSE 'P9' END AS priority,
       CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('request ', o_orderkey) END AS description,
       concat('user-', o_custkey % 50) AS created_by, CAST(o_orderdate AS TIMESTAMP) AS requested_at
FROM {orders} JOIN station_master ON station_idx = o_custkey % 96
""")

_table("completions", (), """
SELECT CASE WHEN o_orderkey % 400 = 2 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS work_order_id,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * (o_custkey % 900) AS completed_at,
       concat('user-', o_custkey % 7) AS completed_by
FROM {orders} WHERE o_orderstatus = 'P'
""")

_table("commands", ("station_master",), """
SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 2 = 0 THEN 'inject_fault' ELSE 'repair' END AS command,
       station_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bearing_wear' END AS failure_mode,
       concat('user-', o_custkey % 50) AS requested_by,
       CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'applied' END AS status, o_orderkey * 10 + 1 AS lsn,
       CAST(o_orderdate AS TIMESTAMP) AS requested_at,
       CASE WHEN o_orderstatus <> 'O'
            THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * (o_custkey % 3000) END AS applied_at
FROM {orders} JOIN station_master ON station_idx = o_custkey % 96
""")

_LINES = [  # own values: customer, vehicle program, part family, buffer min, charge per min, units per hour
    ("Helio Motors", "Helio One", "lower tray", 60, 14000, 40), ("Helio Motors", "Helio One", "upper cover", 75, 14000, 40),
    ("Helio Motors", "Helio Two", "lower tray", 50, 12500, 36), ("Tarn Vehicles", "Tarn Sedan", "cooling plate", 90, 9500, 46),
    ("Tarn Vehicles", "Tarn Sedan", "lower tray", 45, 17500, 42), ("Tarn Vehicles", "Tarn Sedan", "upper cover", 65, 17500, 42),
    ("Tarn Vehicles", "Tarn Van", "lower tray", 80, 10500, 30), ("Ostra Cars", "Ostra City", "cooling plate", 95, 8500, 52),
    ("Ostra Cars", "Ostra City", "lower tray", 55, 11500, 44), ("Ostra Cars", "Ostra City", "upper cover", 70, 11500, 44),
    ("Ostra Cars", "Ostra Peak", "lower tray", 40, 15500, 34), ("Helio Motors", "Helio Two", "cooling plate", 120, 9000, 48),
]
_table("line_programs", (), "SELECT * FROM (VALUES " + ", ".join(
    f"('P{i // 4 + 1}-{'ABCD'[i % 4]}', '{a}', '{b}', '{c}', {d}, {e}, {f})"
    for i, (a, b, c, d, e, f) in enumerate(_LINES)
) + ") AS p(line_id, customer, vehicle_program, part_family, jis_buffer_min, line_stop_charge_usd_per_min,"
    " units_per_hour)")

_STEPS = [  # own values
    ("forming", "formed size"), ("milling", "hole position"), ("frame welding", "seam strength"),
    ("sealing", "bead continuity"), ("transfer", "part sequence"), ("face milling", "surface flatness"),
    ("bracket welding", "weld depth"), ("clinching", "joint strength"),
]
_table("process_steps", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{STATION_TYPES_BY_POSITION[i - 1]}', '{step}', '{quality}')"
    for i, (step, quality) in enumerate(_STEPS, start=1)
) + ") AS s(station_position, station_type, process_step, critical_quality_characteristic)")

_table("plant_access", (), """
SELECT concat('user-', c_custkey) AS principal, concat('P', 1 + (c_nationkey + j) % 3) AS plant_id,
       TIMESTAMP '2024-01-01 00:00:00' AS granted_at
FROM {customer} {fan(2)} WHERE c_custkey % 7 <> 0 AND (j = 0 OR c_custkey % 5 = 0)
""")

# Own values: who may see every plant, and who may see personal data.
_table("group_members", (), """
SELECT principal, member_of FROM (VALUES ('owner', 'owners'), ('user-3', 'all_plants'), ('user-5', 'supervisors'),
                                         ('user-21', 'supervisors'), ('user-21', 'all_plants'))
  AS s(principal, member_of)
""")

_table("event_log", (), """
SELECT event_type, ts AS timestamp, update_id, flow_name,
       CASE event_type
         WHEN 'create_update' THEN concat('{"create_update":{"cause":"', cause, '"}}')
         WHEN 'update_progress' THEN concat('{"update_progress":{"state":"', state, '"}}')
         ELSE concat('{"flow_progress":{"status":"', state, '"',
                     CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(
                       ',"metrics":{"num_output_rows":', n_rows,
                       '},"data_quality":{"expectations":[{"name":"', rule, '","dataset":"readings","passed_records":',
                       n_rows, ',"failed_records":', event_id % 5, '},{"name":"complete_window","dataset":"windows",',
                       '"passed_records":', event_id % 7, ',"failed_records":', event_id % 3, '}]}') END, '}}')
       END AS details
FROM (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS rule, CAST(floor(value) AS BIGINT) AS n_rows,
         CASE event_id % 20 WHEN 0 THEN 'create_update' WHEN 1 THEN 'update_progress' ELSE 'flow_progress' END
           AS event_type,
         concat('update-', CAST(floor(event_id / 1000) AS BIGINT)) AS update_id,
         CASE user_id % 3 WHEN 0 THEN 'site.core.readings_clean' WHEN 1 THEN 'site.core.risk_scores'
              ELSE 'site.core.health_current' END AS flow_name,
         CASE event_id % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' ELSE 'FAILED' END AS state,
         CASE event_id % 2 WHEN 0 THEN 'USER_ACTION' ELSE 'SCHEDULE' END AS cause
  FROM {events}
) e
""")

_table("commit_log", (), """
SELECT event_id AS version, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('user-', user_id % 5) END AS user_name,
       CASE WHEN event_id % 10 = 0 THEN 'maintenance' ELSE 'ingest' END AS writer,
       CASE event_type WHEN 'error' THEN 'OPTIMIZE' ELSE 'WRITE' END AS operation
FROM {events}
""")

_table("lineage_edges", (), """
SELECT concat(CASE event_id % 4 WHEN 0 THEN 'raw.' WHEN 1 THEN 'core.' WHEN 2 THEN 'ops.' ELSE 'tmp.' END, event_type)
         AS source_table,
       concat(CASE user_id % 4 WHEN 0 THEN 'core.' WHEN 1 THEN 'ml.' WHEN 2 THEN 'ops.' ELSE 'tmp.' END, 'table_',
              user_id % 6) AS target_table,
       CASE event_id % 2 WHEN 0 THEN 'PIPELINE' ELSE 'JOB' END AS entity_type, CAST(ts AS TIMESTAMP) AS event_time
FROM {events}
""")

_table("usage_log", (), """
SELECT event_id AS request_id, concat('entity-', event_id % 4) AS served_entity_id,
       concat('user-', user_id) AS requester, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       CAST(ts AS TIMESTAMP) AS request_time
FROM {events}
""")

_table("served_entities", (), """
SELECT DISTINCT concat('entity-', event_id % 4) AS served_entity_id,
       CASE WHEN event_id % 4 < 3 THEN 'station-risk' ELSE 'other' END AS endpoint_name
FROM {events}
""")


def names() -> list[str]:
    return list(_TABLES)


def _closure(wanted: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in _TABLES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in wanted:
        visit(name)
    return order


def ctes(dialect: Dialect, *wanted: str) -> str:
    """`a AS (...), b AS (...)` for the wanted tables and everything they read."""
    return ",\n".join(f"{name} AS ({dialect.render(_TABLES[name][1])})" for name in _closure(wanted))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One logical table as a lazy DataFrame over the driver's Parquet files."""
    return spark.sql(f"WITH {ctes(spark_dialect(sf_dir), name)} SELECT * FROM {name}")
