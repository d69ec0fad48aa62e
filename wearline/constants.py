"""Values that are part of the result semantics."""

# They have to equal the published definitions for results to match.
SENSORS = (
    "vibration_rms",
    "bearing_temp_c",
    "motor_current_a",
    "spindle_rpm",
    "hydraulic_pressure_bar",
    "acoustic_db",
    "cycle_time_s",
)
STATISTICS = ("mean", "std", "max", "min")
WINDOW_SECONDS = 120
SLIDE_SECONDS = 10
SILVER_WATERMARK = "30 seconds"
GOLD_WATERMARK = "10 seconds"
MIN_WINDOW_READINGS = 110
LABEL_HORIZON_S = 300
SPLIT_GAP_S = 600
HIGH_RISK = 0.7
ELEVATED_RISK = 0.4
DOWN_SPEED = 0.2
BANDS = ("DOWN", "HIGH", "ELEVATED", "NORMAL")
STATION_TYPES_BY_POSITION = (
    "press", "cnc_mill", "welder", "robot_arm",
    "conveyor", "cnc_mill", "welder", "press",
)
FAILURE_MODES = ("bearing_wear", "overheating", "seal_leak")
# type -> nominal value per sensor, in the order of SENSORS
NOMINAL = {
    "press": (2.0, 45, 30, 1200, 180, 78, 12),
    "cnc_mill": (1.5, 50, 18, 9000, 60, 72, 45),
    "welder": (0.8, 60, 120, 300, 6, 70, 20),
    "robot_arm": (1.0, 42, 12, 3000, 6, 65, 15),
    "conveyor": (1.2, 38, 8, 1450, 6, 68, 5),
}
# End of fixed values.

FEATURES = tuple(f"{s}_{stat}" for s in SENSORS for stat in STATISTICS)
STATION_KEYS = ("station_id", "plant_id", "line_id", "station_type", "criticality")

#: Fixed value: a station whose newest window is older than this is not shown as current.
FRESH_S = 600
