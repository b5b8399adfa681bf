"""Fixed values of the flow model.

FIXED VALUES — these must equal the behaviour being reproduced, so they are
stated plainly here, in natural order, and used by name everywhere else.
"""

# --- record shape -----------------------------------------------------------
N_GROUPS = 3            # 0 = gap before the packet, 1 = direction, 2 = size
N_SLOTS = 30            # first 30 packets of a flow
LABEL_COL = "APP"
UNKNOWN_LABEL = "Unknown"


def feature_name(grp: int, slot: int) -> str:
    return f"PPI_{grp}_{slot}"


FEATURES = [feature_name(g, s) for g in range(N_GROUPS) for s in range(N_SLOTS)]

# --- adaptive thresholds (per label and global) -----------------------------
TIMING_PCT = 0.98            # group 0 uses p98
TIMING_K_UPPER = 3.0         # min(p98, mean + 3 std)
TIMING_K_FLOOR = 2.5         # upper >= mean + 2.5 std
TIMING_NOISE = 0.005         # noise_std = 0.005 std
SIZE_PCT = 0.95              # group 2 uses p95
SIZE_K_UPPER = 2.5           # min(p95, mean + 2.5 std)
SIZE_K_FLOOR = 2.0           # upper >= mean + 2 std
SIZE_NOISE = 0.05            # noise_std = min(0.05 std, 10)
SIZE_NOISE_CAP = 10.0
BINARY_TOLERANCE = 0.05      # group 1
SYMMETRY_BREAK_CHANCE = 0.05
PROFILE_PERCENTILES = [0.25, 0.50, 0.75, 0.90, 0.95]

# --- value re-weighting before a draw (multiplier per band, first band wins) -
# group 0: [0.001, 100] x2.0; [0.0001, 0.001] or (100, 1000] x1.3; > 10000 x0.3;
#          probability above the column's 75th percentile of probabilities x1.5
# group 1: within 0.001 of -1 or +1 x10; within 0.001 of 0 x5; otherwise x0.1
# group 2: [20, 1500] x2.5; (1500, 9000] x1.5; [1, 20) x1.2; > 9000 x0.2; = 0 x0.8;
#          probability above the column's 70th percentile of probabilities x1.4
# all groups: value in the label's preferred set of the group x1.5
HIGH_FREQ_PCT = {0: 0.75, 2: 0.70}
HIGH_FREQ_BOOST = {0: 1.5, 2: 1.4}
PREFERRED_BOOST = 1.5

# --- preferred patterns (one set per label and group) -----------------------
# group 0: p > 0.05 and 0.0001 <= v <= 1000 -> score 2.0 p; else p > 0.08 -> 1.5 p
# group 1: v in {-1, 0, 1} and p > 0.02 -> 5.0 p; else within 0.01 of -1 or 1 -> 3.0 p
# group 2: 20 <= v <= 1500 and p > 0.04 -> 3.0 p; 1500 < v <= 9000 and p > 0.02 -> 2.0 p;
#          else p > 0.08 -> 1.5 p

# --- clean-up after a draw --------------------------------------------------
JITTER_CHANCE = 0.1          # group 0: 10 % of positive draws get jitter
JITTER_SPAN = 0.02           # uniform in [-2 %, +2 %]
JITTER_FLOOR = 0.0001
DIRECTION_SNAP = 0.2         # group 1: within 0.2 of -1 / +1, else 0
MIN_PACKET = 20.0            # group 2: 0 < v < 20 -> 20

# --- value tokens -----------------------------------------------------------
TOKEN_MAX_VALUE = 65536      # 2 ** 16
TOKEN_BINS = 200             # bin b has label int(2 ** (b * 16 / 200))
STRUCTURAL_TOKENS = ["<SAMPLE_START>", "<SAMPLE_END>", "<PPI_START>", "<PPI_END>",
                     "<APP_START>", "<APP_END>", "<SEP>"]
NEG_TOKEN = "<VAL_NEG>"
ZERO_TOKEN = "<VAL_ZERO>"
UNK_TOKEN = "<UNK_VAL>"
MAX_SEQ_LEN = 512
IGNORE_INDEX = -100

# --- surprise score and repair policy --------------------------------------
PERPLEXITY_THRESHOLD = 8.0
PERPLEXITY_FAILURE = 1000.0
REPAIR_RATE_WIDE = 0.10       # when the median score is >= 50
REPAIR_RATE_NARROW = 0.05     # when the median score is < 50 (threshold = p95)
MEDIAN_CUTOFF = 50.0
ACCEPT_FACTOR = 0.95          # keep a repair only if new < 0.95 old
TIMING_OUTLIER_FACTOR = 3.0   # repair: > 3 x upper -> min(10000, v / 2)
TIMING_CAP = 10000.0
TIMING_SHRINK = 0.5
SIZE_OUTLIER_FACTOR = 2.0     # repair: > 2 x upper -> min(9000, 0.6 v)
SIZE_CAP = 9000.0
SIZE_SHRINK = 0.6

# --- quality scores ---------------------------------------------------------
# timing: 100 - 10 negatives - 5 values above 10000 (floored at 0);
#         realistic = [0.0001, 1000]
# direction: share of cells exactly -1, 0 or +1 (x100); near = within 0.1
# size: 100 - 10 negatives - 2 tiny (0, 20) - 5 huge (> 9000); realistic = [20, 9000]

# --- generation defaults ----------------------------------------------------
N_SAMPLES = 10000
USE_ORIGINAL_PROPORTIONS = True
DEFAULT_SEED = 42

# --- metric-series analysis -------------------------------------------------
TRAIN_SMOOTH_MAX = 5          # window min(5, n // 3) when n > 5
VAL_SMOOTH_MAX = 3            # window min(3, n // 2) when n > 3
TREND_POINTS = 3
CONVERGED_SLOPE = 0.001
OVERFIT_RATIO = 1.2
GOOD_RATIO = 1.1
TRAIN_HIST_BINS = 20
VAL_HIST_BINS = 15

# --- splits and batches -----------------------------------------------------
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
TEST_RATIO = 0.1
SPLIT_SEED = 42
RATIO_TOLERANCE = 1e-6
BATCH_SIZE = 8
EARLY_STOPPING_PATIENCE = 5
AUGMENT_CHANCE = 0.3         # share of rows that get Gaussian noise
AUGMENT_SCALE = 0.05         # noise std = 0.05 |v|
