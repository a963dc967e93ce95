"""Values that all operators share."""

# Fixed values of the analysis.
YEAR_DAYS = 365.25
HORIZONS = {"24h": 1 / 365.25, "7d": 7 / 365.25, "30d": 30 / 365.25, "90d": 90 / 365.25, "1y": 1.0}
MIN_LAT, MAX_LAT, MIN_LON, MAX_LON = 20.0, 28.0, 88.0, 96.0
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEG_LAT, KM_PER_DEG_LON_EQUATOR, MID_LATITUDE = 110.574, 111.320, 24.0
DEPTH_GROUPS = [("shallow", 0.0, 25.0), ("intermediate", 25.0, 70.0), ("deep", 70.0, 800.0)]
MW_FAMILY = ["gcmt", "iscgem", "mw", "mw_iscgem", "mwb", "mwc", "mwc_iscgem", "mwp", "mwr", "mww"]
#: (name, input type, slope, intercept, sigma, lowest, highest), tried by rising lowest magnitude.
MAG_RELATIONS = [
    ("ms_low", "ms", 0.67, 2.07, 0.37, 3.0, 6.1),
    ("mb", "mb", 0.85, 1.03, 0.41, 3.5, 6.2),
    ("ms_high", "ms", 1.10, -0.57, 0.28, 5.8, 8.0),
]
LOG_EPS = 1e-12
ECE_EDGES = [0.0, 0.05, 0.10, 0.20, 0.40, 0.60, 0.80, 1.01]
#: (level, least forecasts, least evaluated)
EVIDENCE_LEVELS = [(0, 0, 0), (1, 1, 1), (2, 5, 3), (3, 20, 10), (4, 50, 30)]
ETAS = {"mu_per_year": 20.0, "k": 0.02, "alpha": 0.8, "c_days": 0.01, "p": 1.1, "mc": 4.0, "b": 0.9, "tau_max_days": 365.0}
