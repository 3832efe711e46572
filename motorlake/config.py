"""Thresholds, rule tables and texts.

Everything in this module is a fixed value: results are only right when these
are exactly as stated, so they are kept as plain literals in one place.
"""

# ---- fixed values: datasets and their business keys -------------------------
EVENT_DATASETS = ["telemetry", "diagnostics"]
BUSINESS_KEYS = {
    "telemetry": ["vehicle_id", "timestamp"],
    "diagnostics": ["vehicle_id", "timestamp", "code"],
    "vehicles": ["vehicle_id"],
    "service": ["service_id"],
    "warranty": ["claim_id"],
    "parts": ["part_id", "dealer_id"],
    "dealers": ["dealer_id"],
    "components": ["part_id"],
    "customers": ["customer_id"],
    "vehicle_customer_map": ["vehicle_id"],
}
DUPLICATE_RULE = "DUPLICATE_KEY"

# ---- fixed values: cleaning bounds -------------------------------------------
TELEMETRY_BOUNDS = {
    "rpm": (0, 9000),
    "temperature": (-40.0, 160.0),
    "battery": (9.0, 16.0),
    "vibration": (0.0, 15.0),
}
DTC_PATTERN = "^[PCBU][0-9]{4}$"
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERE = ["CRITICAL", "HIGH"]

# ---- fixed values: event contract bounds ---------------------------------------
CONTRACT_TELEMETRY_BOUNDS = {
    "rpm": (0.0, 9000.0),
    "temperature": (-40.0, 150.0),
    "battery": (0.0, 100.0),
    "vibration": (0.0, 50.0),
}
CONTRACT_CODE_LENGTH = (2, 10)
CONTRACT_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL", "WARNING", "INFO"]
TRANSPORT_FIELDS = [
    "_producer_id",
    "_sent_at",
    "_kafka_topic",
    "_kafka_partition",
    "_kafka_offset",
]
TELEMETRY_FIELDS = ["vehicle_id", "timestamp", "rpm", "temperature", "battery", "vibration"]
DIAGNOSTIC_FIELDS = ["vehicle_id", "timestamp", "code", "component", "severity"]
TELEMETRY_TOPIC = "vehicle-telemetry"
DIAGNOSTICS_TOPIC = "diagnostic-events"

# ---- fixed values: diagnostic evidence (code group, reading, limit) ---------------
DTC_EVIDENCE = [
    (["P0217", "P0420"], "temperature", ">=", 55.0),
    (["P0562", "B0001", "U0100"], "battery", "<=", 11.6),
    (["P0300", "C0035", "C0561"], "vibration", ">=", 4.2),
]
REPAIR_COST_FLOOR = 350.0

# ---- fixed values: powertrain by model -------------------------------------------
POWERTRAIN_BY_MODEL = {
    "Apex": "ICE-Gasoline",
    "Titan": "Diesel",
    "Pulse": "EV",
    "Horizon": "Hybrid",
}
UNKNOWN_KEY = -1
CALENDAR = ("2020-01-01", "2030-12-31")

# ---- fixed values: daily health and component risk -----------------------------------
SESSION_GAP_SECONDS = 300
LATE_AFTER = "1 day"
VIBRATION_ALERT = 2.5
TEMPERATURE_ALERT = 105.0
BATTERY_ALERT = (11.8, 15.0)

# ---- fixed values: features --------------------------------------------------------
LOOKBACK_DAYS = 7
HORIZON_DAYS = 14
HIGH_RPM = 4500
ROUTINE_ISSUES = ["Scheduled routine maintenance and multi-point inspection"]
BREAKDOWN_WORDS = [
    "repair",
    "replacement",
    "failure",
    "leak",
    "solenoid",
    "strut",
    "rotor",
    "pump",
    "alternator",
]
FAULT_BEFORE_HOURS = 2
FAULT_AFTER_HOURS = 6
DEMAND_LAGS = [7, 14]
DEMAND_WINDOW_DAYS = 7
NEVER_SERVICED_DAYS = 180
FEATURE_DEFAULTS = {
    "avg_engine_temp": 85.0,
    "max_engine_temp": 85.0,
    "vibration_stddev": 0.0,
    "battery_min": 90.0,
    "high_rpm_pings": 0,
    "severe_dtc_count": 0,
    "service_count": 0,
}
FAILURE_FEATURES = [
    "avg_engine_temp",
    "max_engine_temp",
    "vibration_stddev",
    "battery_min",
    "high_rpm_pings",
    "severe_dtc_count",
    "service_count",
    "days_since_service",
]
SENSOR_FEATURES = [
    "rpm",
    "temperature",
    "battery",
    "vibration",
    "norm_rpm",
    "norm_temperature",
    "norm_vibration",
    "vibration_per_rpm",
]
DEMAND_FEATURES = [
    "lag_7",
    "lag_14",
    "mean_prev_7",
    "day_of_week",
    "is_weekend",
]
CLAIM_FEATURES = ["claim_amount", "median_ratio", "iqr_distance", "vehicle_claims"]
STREAM_CENTRES = {"rpm": (2500.0, 1500.0), "temperature": (85.0, 20.0), "vibration": (1.0, 1.0)}

# ---- fixed values: models and acceptance gates -----------------------------------------
SEED = 42
N_TREES = 100
FAILURE_DEPTH = 4
DEMAND_DEPTH = 5
IFOREST_SAMPLE = 256
RISK_TIERS = [(0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM")]
RISK_TIER_DEFAULT = "LOW"
CALIBRATION_PERCENTILE = 98.8
TRIAGE_RANK = 0.80
PSI_LIMIT = 0.20
KS_ALPHA = 0.05
GATES = {
    "roc_auc": (">=", 0.70),
    "pr_auc": (">=", 0.35),
    "brier": ("<=", 0.15),
    "fpr": ("<=", 0.02),
    "mae": ("<=", 0.60),
    "lift": (">=", 0.10),
}

# ---- fixed values: alert rules ---------------------------------------------------------
RISK_TRIGGER = 0.70
STREAK_LENGTH = 3
SURGE_LIMIT = 0.25
SURGE_BASELINE = 10.0
STREAM_TEMPERATURE_FLAG = (-10.0, 105.0)
STREAM_VIBRATION_FLAG = 4.0

ACTION_TEXT = {
    "RULE_1_FAILURE_RISK": "Pre-emptive service work-order drafted for vehicle %s. "
    "Failure probability %.1f%% exceeds proposed initial trigger %.0f%%.",
    "RULE_2_SENSOR_ANOMALY": "Critical telemetry anomaly incident flagged for %s. "
    "Observed %d consecutive pings with score >= %.4f.",
    "RULE_2_SEVERE_DTC": "Severe diagnostic event (%s - %s) detected on vehicle %s. "
    "Immediate service inspection recommended.",
    "RULE_3_DEMAND_SURGE": "Service demand surge (+%.1f%%) detected for dealer %s. "
    "Forecasted volume (%.1f) exceeds baseline capacity (%.1f) by > %.0f%%.",
    "RULE_4_WARRANTY_AUDIT": "Warranty claim %s prioritized for forensic audit review. "
    "Outlier percentile rank %.2f meets proposed audit threshold %.2f. "
    "Strictly audit prioritization for sampling inspection.",
}
AUDIT_NOTE = "Audit prioritization only; no claim of illegal activity"

# ---- fixed values: quarantine rule codes and reasons ---------------------------------------
# rule code -> reason; %s is filled with the offending value where the reason has one.
REASONS = {
    "RULE_TEL_PK_NOT_NULL": "Mandatory vehicle_id or timestamp is null/empty",
    "RULE_TEL_TYPE_ERROR": "Failed to parse numerical sensor signals",
    "RULE_TEL_RPM_RANGE": "RPM value %s outside valid range [0, 9000]",
    "RULE_TEL_TEMP_RANGE": "Temperature %s°C outside valid range [-40.0, 160.0]",
    "RULE_TEL_BATTERY_RANGE": "Battery voltage %sV outside valid range [9.0, 16.0]",
    "RULE_TEL_VIB_RANGE": "Vibration index %s mm/s outside valid range [0.0, 15.0]",
    "RULE_DTC_PK_NOT_NULL": "Mandatory vehicle_id, timestamp, or code is null/empty",
    "RULE_DTC_CODE_REGEX": "Diagnostic code '%s' does not match standard OBD-II regex ^[PCBU][0-9]{4}$",
    "RULE_DTC_SEVERITY": "Invalid severity tier '%s'; must be LOW, MEDIUM, HIGH, or CRITICAL",
    "RULE_VEH_NOT_NULL": "Mandatory vehicle_id, model, or dealer_id is null/empty",
    "RULE_VEH_DATE_RANGE": "Manufacture date %s is in the future relative to snapshot date",
    "RULE_SRV_TYPE_ERROR": "Invalid cost value",
    "RULE_SRV_PK_NOT_NULL": "Mandatory service_id or vehicle_id is null/empty",
    "RULE_SRV_COST_RANGE": "Negative service repair invoice cost %s detected",
    "RULE_SRV_DATE_VALID": "Service visit date %s is in the future relative to snapshot date",
    "RULE_WRN_TYPE_ERROR": "Invalid claim amount value",
    "RULE_WRN_PK_NOT_NULL": "Mandatory claim_id or vehicle_id is null/empty",
    "RULE_WRN_AMOUNT_POS": "Non-positive warranty claim amount %s detected; must be > 0.00",
    "RULE_WRN_DATE_VALID": "Warranty claim date %s is in the future relative to snapshot date",
    "RULE_PRT_TYPE_ERROR": "Invalid stock or lead_time value",
    "RULE_PRT_PK_NOT_NULL": "Mandatory part_id or dealer_id is null/empty",
    "RULE_PRT_STOCK_RANGE": "Negative inventory stock level %s detected; must be >= 0",
    "RULE_PRT_LEAD_RANGE": "Procurement lead time %s is invalid; must be >= 1",
    "RULE_DLR_NOT_NULL": "Mandatory dealer_id is null or empty",
    "RULE_CMP_NOT_NULL": "Mandatory part_id is null or empty",
    "RULE_CUST_NOT_NULL": "Mandatory customer_id is null or empty",
    "RULE_VCM_NOT_NULL": "Mandatory vehicle_id or customer_id is null or empty",
    "DUPLICATE_KEY": "Duplicate record for key %s; superseded by primary record",
}
