"""Default parameters of the registered queries (FIXTURES.md section 2)."""

YEAR = 1998
METRIC = "yoy_pct"
PRICE = "year_close"
WEEKLY_PRICE = "w_close"
GROWTH_LOW = 100
GROWTH_HIGH = 1000
THRESHOLD = 100
KEYWORD = "bolt"
DRILL_BIN = 11
BURST_HITS = 2
OUTLIER_K = 1.5
HIST_BINS = 25

# Other choices a user can make, each with a key of its own.
OTHER_METRIC = "mom_pct"
OTHER_PRICE = "year_high"
OTHER_LOW, OTHER_HIGH = 20, 300
OTHER_THRESHOLD = 50
DOWN_BIN = 8
# Limits a caller asks for.
DRILL_TOP = 10
BURST_TOP = 10
REPORT_ROWS = 25
REPORT_HITS = 3
