"""Results depend on them being exactly these."""

# --- statement files -------------------------------------------------------
# header names (trimmed, lower case) of each field
HEADER_ALIASES = {
    "date": ["date", "transaction date", "txn date"],
    "time": ["time", "transaction time"],
    "details": [
        "transaction details", "details", "description", "narration",
        "particulars", "to / from", "merchant", "paid to",
    ],
    "type": ["type", "transaction type", "debit/credit", "dr/cr", "direction"],
    "amount": ["amount", "amount (inr)", "amount(inr)", "transaction amount"],
    "reference": [
        "utr", "reference", "reference no", "reference id", "transaction id", "utr no",
    ],
}
REQUIRED_FIELDS = ["date", "amount"]
SNIFF_WORDS = ["date", "amount", "transaction"]

# date shapes: (regex of the text, Spark patterns in order of preference); a time may follow
DATE_SHAPES = [
    (r"^[A-Za-z]", ["[MMMM][MMM] d, yyyy"]),
    (r"^\d{1,2} [A-Za-z]", ["d [MMMM][MMM] yyyy"]),
    (r"^\d{4}-", ["yyyy-M-d"]),
    (r"^\d{1,2}-", ["d-M-yyyy"]),
    (r"^\d{1,2}/", ["d/M/yyyy", "M/d/yyyy"]),
]
TIME_SHAPES = "[ h:m a][ H:m:s]"

DEBIT_WORDS = ["debit", "dr", "debited", "paid", "sent", "-"]
CREDIT_WORDS = ["credit", "cr", "credited", "received", "+"]

REASON_NO_HEADER = "CSV header row (Date/Amount) not found"
REASON_NO_COLUMN = "CSV missing required '%s' column"
REASON_DATE = "unparseable date"
REASON_AMOUNT = "unparseable amount"
REASON_DIRECTION = "unknown direction"
REASON_NO_ADAPTER = "No adapter recognizes the file"
REASON_NO_READER = "No reader for %s files"
UNKNOWN = "UNKNOWN"

# --- statement text ----------------------------------------------------------
TEXT_DATE = r"[A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4}"
TEXT_TIME = r"\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?"
TEXT_AMOUNT = r"(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)"
TEXT_CREDIT_WORDS = ["credit", "received from", "refund", "money received"]
TEXT_DROP_WORDS = ["debit", "credit", "paid to", "received from", "payment to"]
TEXT_DATE_PATTERN = "MMM d yyyy"
REASON_NO_FIELDS = "no date/amount in record"
REASON_BAD_FIELDS = "unparseable date/amount"
TEXT_CONFIDENCE = 0.7
TABLE_CONFIDENCE = 1.0

# --- merchant names ----------------------------------------------------------
HANDLE_CHAR = "[a-zA-Z0-9._-]"
TXN_PHRASES = [
    "paid to", "received from", "payment to", "sent to", "money sent to",
    "money received from", "to", "from",
]
NOISE_WORDS = [
    "pvt", "ltd", "limited", "india", "payment", "upi", "txn", "ref", "order",
]
OWNER_TERMS = ("self", "own account", "my account", "upi lite")
REFUND_WORD = "refund"
OFFSET_DAYS = 2
REFERENCE_HASH_LENGTH = 16
DEDUP_KEY_LENGTH = 32

# --- features ------------------------------------------------------------------
FEATURE_COLUMNS = [
    "log_amount", "dow_sin", "dow_cos", "day_of_month_norm", "merchant_frequency",
    "recency_days", "is_recurring", "amount_stability",
]
CLUSTERING_COLUMNS = [
    "log_amount", "merchant_frequency", "is_recurring", "amount_stability",
]
RECENCY_CAP = 9999
RECURRING_PERIODS = [7, 30, 365]
RECURRING_CV_MAX = 0.25
RECURRING_TOLERANCE = 0.30
RECURRING_MIN_ROWS = 3
RECURRING_MIN_GAPS = 2

# --- anomalies -----------------------------------------------------------------
ROBUST_Z_FACTOR = 0.6745
MAD_FLOOR = 1e-9
ROBUST_Z_MIN_ROWS = 3
EPS_PERCENTILE = 0.9
DENSITY_REASON = "density outlier (DBSCAN)"
ROBUST_Z_REASON = "unusual amount for %s (z=%s)"

# --- labels --------------------------------------------------------------------
BUCKET_LOW = 0.33
BUCKET_HIGH = 0.66
FLAT_RANGE = 1e-9
BIG_AMOUNT = 1500
SMALL_AMOUNT = 150
LABEL_RECURRING = "Recurring bills & subscriptions"
LABEL_FREQUENT_BIG = "Frequent big-ticket spending"
LABEL_FREQUENT = "Frequent everyday spending"
LABEL_BIG = "Large one-off purchases"
LABEL_OCCASIONAL = "One-off & occasional spending"
LABEL_SMALL = "Small everyday spend"
LABEL_MID = "Mid-size regular spend"

# --- insights ------------------------------------------------------------------
CURRENCY = "₹"
TREND_MIN_DELTA = 1
TREND_WARN_PCT = 30
NEW_MERCHANT_SAMPLE = 3

# --- reconciliation and reads -----------------------------------------------------
RECONCILE_TARGET = 0.90
SAMPLE_MISSES = 10
PAGE_LIMIT = 500
PAGE_LIMIT_MAX = 5000
UNPARSED_LIMIT = 200
