"""Configuration as data: fixed values and the feature lists of the analyses."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values used by the analysis we rebuild;
# they are stated here plainly and in one place.
# ---------------------------------------------------------------------------
WINTER_MONTHS = (12, 1, 2)          # season "Winter"
SPRING_MONTHS = (3, 4, 5)           # season "Spring"; every other month is "Other"
BUCKET_MINUTES = 30                 # time bucket width of the interval join
FOOD_SCALE = 4.0                    # food availability is expressed as a fraction of 4
FOOD_DECIMALS = 2                   # ... rounded half-even to 2 decimals
IQR_FACTOR = 1.5                    # outlier fences: q1 - 1.5 IQR, q3 + 1.5 IQR
OUTLIER_QUANTILES = (0.25, 0.75)
CORR_THRESHOLD = 0.5                # "highly correlated pair" threshold
VIF_THRESHOLD = 5.0                 # drop the worst feature while its VIF exceeds 5
VIF_MAX_ROUNDS = 10
LOG_SHIFT = 1e-6                    # log(x + 1e-6)
TEST_SIZE = 0.2                     # train/test split fraction
SPLIT_SEED = 42                     # split seed of the seasonal models
UNIVARIATE_SEED = 0                 # split seed of the univariate study
N_FOLDS = 5
FOLD_SEED = 42
HIST_BINS = 30
KDE_GRID = 200
TOP_K_COEF = 10
ONEHOT_DROP_FIRST = True
# ---------------------------------------------------------------------------

# Rounding of doubles in query outputs (results are compared by value hash).
OUT_DECIMALS = 6

# Fixture A (landings joined to 30-minute observations).
A_TARGET = "time_to_food"
A_EXCLUDE = ("time_to_food", "start_time", "date", "month", "month_num", "key")
# Per-segment feature lists of the seasonal models on fixture A
# (v1: winter and "spring" = not winter).
A_WINTER_FEATURES = ["min_after_arrival", "risk", "reward", "arrival_number", "arrivals_exceed", "season_Winter"]
A_SPRING_FEATURES = ["min_after_arrival", "risk", "reward", "arrival_minutes", "season_Winter"]
# Fixture D (orders as landings, all seasons) also has the minutes after sunset.
D_SPRING_FEATURES = ["min_after_arrival", "risk", "reward", "min_after_sunset", "arrival_minutes", "season_Winter"]
# Heat maps of the second and third analysis.
HEATMAP_V2 = ["arrival_number", "risk", "arrivals_exceed", "arrival_present", "food_availability"]
HEATMAP_V3 = ["time_to_food", "min_after_arrival", "risk", "reward", "min_after_sunset", "landing_number", "arrival_minutes",
              "arrival_number", "arrival_present", "food_fraction", "month", "bucket_count", "log_arrivals_exceed",
              "risk_arrivals", "risk_reward"]
# Baseline of the log-transform study (no-intercept OLS) and the candidates swapped for their log.
A_LOG_BASE = ["min_after_arrival", "risk", "reward", "arrival_number", "arrivals_exceed"]
A_LOG_CANDIDATES = ["risk", "reward", "arrival_number", "arrivals_exceed", "min_after_arrival"]
# Columns repaired by the IQR / median rule.
A_REPAIR_COLUMNS = ["time_to_food", "min_after_arrival", "arrival_number"]

# Fixture B (orders with per-order lineitem aggregates), seasonal segments.
B_TARGET = "target"
B_FEATURES = ["n_lines", "avg_qty", "avg_disc", "avg_tax", "urgent"]
# A segment is a union of disjoint "atoms" (values of the atom column).
B_SEGMENTS = {"winter": ["winter"], "not_winter": ["not_winter"], "year": ["winter", "not_winter"]}
SCATTER_EACH = 3                    # points of each cell of a bounded scatter chart
