"""Fixed values shared by the operators."""

# Sentiment classes in their canonical order.
LABELS = ["negative", "neutral", "positive"]

# Language codes and names.
LANG_NAMES = {
    "jav": "Javanese",
    "sun": "Sundanese",
    "ace": "Acehnese",
    "bjn": "Banjarese",
    "mad": "Madurese",
    "min": "Minangkabau",
    "ban": "Balinese",
}

# Share of rows identified as the target language in the seed data, per cent.
BASELINE_PURITY = {
    "jav": 93.4, "sun": 97.4, "ace": 95.4, "bjn": 95.0,
    "mad": 96.8, "min": 96.0, "ban": 83.0,
}

# Loop limits and thresholds.
MAX_RETRY = 2
PARSE_RETRY = 2
BATCH_SIZE = 5
SENTENCES_PER_SEED = 5
DEDUP_THRESHOLD = 0.5
DEFAULT_STD = 14.0

# Leakage tiers and the blocking threshold.
TRIGRAM_BLOCK = 0.3
TIER1_MIN = 0.85
TIER2_MIN = 0.6

# Synthetic shares kept by the ratio variants.
RATIOS = {"40": 0.40, "50": 0.50, "60": 0.60}

# Lower and upper token counts of the length buckets.
BUCKETS = [(0, 9), (10, 19), (20, 29), (30, 39), (40, 49), (50, 200)]
SHARE_BUCKETS = [(0, 9), (10, 19), (20, 29), (30, 39), (40, 49), (50, 100)]

# Score gates, per cent.
GATE_F1 = 80.0
GATE_GAP = 10.0
