"""Results depend on these exact names, patterns, formats and limits."""

# Topics and identities
TOPIC_PREFIX = "sensor-data-"
TOPIC_PATTERN = "^sensor-data-quad.*"
UNKNOWN_ASSET = "unknown_asset"
UNKNOWN_TABLE = "unknown_table"
UNKNOWN_SENSOR = "unknown"

# Payload keys with a meaning of their own; never flattened
CANONICAL_KEYS = ("time", "value", "daqid")

# Rollups
STATS = ("mean", "min", "max")
NON_MEASURES = ("partition", "offset", "timestamp")

# Landing and early-flush limits
RAW_FLUSH_AGE = "5 minutes"
MINUTE_FLUSH_ROWS = 60
MINUTE_FLUSH_AGE_S = 120

# Mirroring and retention
SIZE_TOLERANCE_BYTES = 1024
BYTES_PER_MB = 1024 * 1024
COPY_RETRIES = 3
COPY_RETRY_DELAY_S = 1
COPY_CHUNK_BYTES = 1024 * 1024
RETENTION_DAYS = 7

# Monitoring limits
STALE_AFTER_S = 300
RATE_WINDOW = "5 minutes"
RATE_WINDOW_S = 300
SILENCE_AFTER_S = 900
LAG_LIMIT = 10_000
USAGE_LIMIT = 0.85
BACKLOG_LIMIT = 1_000
ROLLUP_DELAY_S = 7_200
