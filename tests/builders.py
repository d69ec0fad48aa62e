"""Small hand-made tables."""

from datetime import datetime, timedelta

from wearline import schemas
from wearline.constants import NOMINAL, SENSORS

T0 = datetime(2024, 1, 1)


def at(second: float) -> datetime:
    return T0 + timedelta(seconds=second)


def station_master(spark, *rows):
    """rows: (station_id, plant_id, line_id, station_type[, nominal factor])"""
    columns = "station_id string, plant_id string, plant_name string, line_id string, station_type string, criticality string, " + \
        ", ".join(f"nom_{s} double" for s in SENSORS)
    data = []
    for row in rows:
        sid, plant, line, kind = row[:4]
        factor = row[4] if len(row) > 4 else 1.0
        data.append((sid, plant, f"Name of {plant}", line, kind, "high", *[float(n) * factor for n in NOMINAL[kind]]))
    return spark.createDataFrame(data, columns)


def reading(station, second, event_id=None, kind="press", factor=1.0, **sensors):
    values = {s: float(n) * factor for s, n in zip(SENSORS, NOMINAL[kind])}
    values.update(sensors)
    ts = None if second is None else at(second)
    seq = None if second is None else int(second)
    return (event_id or f"{station}-{second}", "gw", "wrong-plant", "wrong-line", station, ts, seq,
            *[values[s] for s in SENSORS], "1")


def readings(spark, rows):
    return spark.createDataFrame(rows, schemas.SENSOR_READINGS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple(str(v) for v in r))
