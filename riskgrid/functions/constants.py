"""Fixed values that decide results; each must stay as it is."""

from __future__ import annotations

# Region, grid and calendar.
KM_PER_DEGREE_LAT = 111.0
DEFAULT_CELL_SIZE_KM = 5.0
DEFAULT_REFERENCE_LATITUDE = 50.6
DEFAULT_BBOX = "-121.5,49.8,-119.0,51.5"
PANEL_START = "2012-01-01"
PANEL_END = "2024-12-31"
MULTI_DAY_WINDOW = 3
SEASON_START = "05-01"
SEASON_END = "10-15"
LOOKBACK_SEASON_START = "04-01"
TRAIN_END = "2023-01-01"
VAL_END = "2024-01-01"
HOLDOUT_YEARS = tuple(range(2017, 2025))

# Detections.
VEGETATION_FIRE_TYPE = 0

# Weather and derived features.
KELVIN_OFFSET = 273.15
MM_PER_METRE = 1000.0
RAIN_THRESHOLD_MM = 1.0
ROLLING_WINDOWS = (7, 30)
NEIGHBOR_WINDOWS = (1, 3, 7)
LIVE_LOOKBACK_DAYS = 45
INSTANT_VARIABLES = ("t2m", "d2m", "u10", "v10", "swvl1")
SEQUENCE_CHANNELS = ("t2m", "relative_humidity", "wind_speed", "precip_mm", "swvl1")
SEQUENCE_LENGTH = 30
BACKGROUND_ROWS = 300

# Static attributes.
UNKNOWN_FUEL = "unknown"
CENTROID_BOX_HALF_DEGREE = 0.00025
CODE_COLUMNS = ("ffmc", "dmc", "dc", "isi", "bui", "fwi")
TERRAIN_COLUMNS = ("elevation_m", "slope_degrees", "aspect_sin", "aspect_cos")

# The columns a complete row must have.
COMPLETE_COLUMNS = (
    "days_since_rain",
    "precip_7d",
    "precip_30d",
    "wind_speed",
    "wind_dir_sin",
    "wind_dir_cos",
    "relative_humidity",
    "t2m_mean_7d",
    "t2m_trend_7d",
    "rh_mean_7d",
    "neighbor_fire_count_1d",
    "neighbor_fire_count_3d",
    "neighbor_fire_count_7d",
    "cape",
    "convective_precip_mm",
    *CODE_COLUMNS,
    *TERRAIN_COLUMNS,
)

# The served model's input columns, in order.
WEATHER_FEATURES = (
    "t2m",
    "swvl1",
    "precip_mm",
    "relative_humidity",
    "wind_speed",
    "days_since_rain",
    "precip_7d",
    "precip_30d",
    "t2m_mean_7d",
    "rh_mean_7d",
)
NEIGHBOR_FEATURES = (
    "neighbor_fire_count_1d",
    "neighbor_fire_count_3d",
    "neighbor_fire_count_7d",
)
SERVED_FUEL_CODES = (
    "C-2",
    "C-3",
    "C-4",
    "C-5",
    "C-6",
    "C-7",
    "D-1/D-2",
    "M-1/M-2 (20 PC)",
    "M-1/M-2 (25 PC)",
    "M-1/M-2 (30 PC)",
    "M-1/M-2 (40 PC)",
    "M-1/M-2 (45 PC)",
    "M-1/M-2 (50 PC)",
    "M-1/M-2 (55 PC)",
    "M-1/M-2 (65 PC)",
    "M-1/M-2 (Burned)",
    "Non-fuel",
    "O-1a",
    "S-2",
)
FUEL_FEATURES = tuple(f"fuel_type_{code}" for code in SERVED_FUEL_CODES)
SERVED_FEATURES = WEATHER_FEATURES + NEIGHBOR_FEATURES + FUEL_FEATURES

# Parameters of the served forest and the search spaces.
SERVED_FOREST = {
    "n_estimators": 238,
    "max_depth": 6,
    "max_features": 0.6063110478838847,
    "min_samples_leaf": 7,
}
FOREST_GRID = {
    "n_estimators": [200, 400],
    "max_depth": [8, 16],
    "min_samples_leaf": [1, 5],
}
BOOSTED_GRID = {
    "n_estimators": [200, 400],
    "max_depth": [4, 6],
    "learning_rate": [0.05, 0.1],
}
FOREST_SPACE = {
    "n_estimators": ("int", 150, 500),
    "max_depth": ("int", 4, 17),
    "min_samples_leaf": ("int", 1, 10),
    "max_features": ("uniform", 0.3, 1.0),
}
BOOSTED_SPACE = {
    "n_estimators": ("int", 100, 500),
    "max_depth": ("int", 3, 8),
    "learning_rate": ("loguniform", 0.01, 0.3),
    "subsample": ("uniform", 0.6, 1.0),
    "colsample_bytree": ("uniform", 0.6, 1.0),
}

# Daily moisture codes (Van Wagner and Pickett 1985; day
# lengths from Van Wagner 1987), January to December.
STARTUP_FFMC = 85.0
STARTUP_DMC = 6.0
STARTUP_DC = 15.0
RESET_MONTH_DAY = "03-01"
DMC_DAY_LENGTH_ABOVE_30N = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DMC_DAY_LENGTH_10N_30N = (7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8)
DMC_DAY_LENGTH_EQUATOR = 9.0
DMC_DAY_LENGTH_30S_10S = (10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2)
DMC_DAY_LENGTH_BELOW_30S = (11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8)
DC_FACTOR_ABOVE_20N = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
DC_FACTOR_TROPICS = 1.4
DC_FACTOR_BELOW_20S = (6.4, 5.0, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8)
