"""Names, word lists, patterns and limits that decide results."""

# --- record fields ---------------------------------------------------------
EXPORT_FIELDS = ("export_metadata", "data")
METADATA_FIELDS = ("created_at", "total_records", "format")
RECORD_FIELDS = ("timestamp", "message", "process_name", "log_level")
LENIENT_FIELDS = ("timestamp", "message", "process_name")
EXPORT_FORMAT = "json"

# --- log levels ------------------------------------------------------------
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
LEVEL_NUMBERS = {level: number for number, level in enumerate(LEVELS)}
LEVEL_DEFAULT = 1

# --- message patterns ------------------------------------------------------
MAC = r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})"
IPV4_IN_TEXT = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CONNECTION_EVENT = "AP-STA-CONNECTED|AP-STA-DISCONNECTED|STA-ASSOC|STA-DISASSOC"
AUTH_EVENT = "AUTH|AUTHENTICATION|LOGIN|LOGOUT"
ERROR_EVENT = "ERROR|FAILED|DENIED|REJECTED"
CONNECTED = "AP-STA-CONNECTED"
FAILURE = "ERROR|FAILED"

# --- summary patterns ------------------------------------------------------
AUTH_FAILURE = "authentication failure|auth failed"
DEAUTH = "deauthentication|deauth"
BEACON = "beacon"
SSID = "SSID='([^']+)'"
REASON_CODE = r"reason=(\d+)"
STATUS_CODE = r"status=(\d+)"
SIGNAL = r"signal=(-?\d+)"
CHANNEL = r"channel=(\d+)"
DATA_RATE = r"rate=(\d+)"
PACKET_LOSS = r"packet_loss=(\d+)"
DEFAULT_HOUR = 12.0
DEFAULT_WEEKDAY = 3.0
CODE_TOP = 10

# --- value formats ---------------------------------------------------------
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_FORMAT = r"^https?://[^\s/$.?#].[^\s]*$"
MAC_FORMAT = r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
IPV4_FORMAT = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
)
#: year, dash, month, day, hour, colon, minute, second, fraction, offset; extended and basic forms
ISO_FORMAT = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
    r"(?:[^0-9]([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"
)

# --- clock -----------------------------------------------------------------
BUSINESS_START = 9
BUSINESS_END = 17
WINDOWS = {"window_5min": 5, "window_15min": 15, "window_1hour": 60}

# --- training suitability --------------------------------------------------
WIFI_PROCESSES = ("hostapd", "wpa_supplicant")
MIN_WIFI_RATIO = 0.1
MIN_DAYS = 1

# --- service logs ----------------------------------------------------------
JOB_KEYWORDS = (
    "training", "model", "feature", "export", "validation",
    "train", "fit", "evaluate", "progress", "step",
    "training_id", "model_path", "export_file",
)
JOB_ID_PATTERN = r"training[_-]?id[:\s]+([a-zA-Z0-9_-]+)"
PROGRESS_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
SERVICE_FIELDS = ("timestamp", "level", "message", "module", "function", "line", "logger")
ACTIVE_JOB_ROWS = 5

# --- model defaults --------------------------------------------------------
TREES = 100
SAMPLE_PER_TREE = 256
CONTAMINATION = 0.1
SEED = 42
NEIGHBOURS = 20
SCORE_QUANTILE = 0.9
CV_FOLDS = 5
IMPORTANCE_REPEATS = 5

# --- evaluation limits -----------------------------------------------------
SWEEP_QUANTILES = (0.50, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99)
SUPERVISED_MINIMUMS = {
    "accuracy": 0.8, "precision": 0.7, "recall": 0.7, "f1_score": 0.7, "roc_auc": 0.8,
}
MIN_SCORE_STD = 0.01
MAX_ANOMALY_RATIO = 0.15
MIN_SCORE_MEAN = -1.0
GATE_PASS_RATE = 0.5
GATE_MIN_AUC = 0.5
DRIFT_THRESHOLD = 0.1

# --- storage ---------------------------------------------------------------
KEEP_MODELS = 5
MAX_EXPORT_MB = 100
