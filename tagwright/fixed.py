"""Fixed values of the listing-price task, kept together as plain text.

They must equal the values of the pricing scripts this library reproduces, or results differ.
"""

# ---- missing-value markers of the tab-separated reader (documented pandas defaults) ----
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fill values: three models, three policies ----
FILL_CONSTANT = {"category_name": "missing", "brand_name": "missing", "item_description": "missing"}
FILL_TREE = {"name": "missing", "category_name": "Other", "brand_name": "missing", "item_description": "None"}
FILL_LINEAR = {"name": "", "category_name": "other/other/other", "brand_name": "", "item_description": ""}
PLACEHOLDER = "No description yet"

# ---- character classes, spelled out so Java and RE2 agree with Python's Unicode \d \s \w ----
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# ---- text patterns ----
KARATS = rf"({DIGIT})([{SPACE}-]?)(karat|karats|carat|carats|kt)([^{WORD}])"  # -> group 1, 'k', group 4
UNITS = rf"({DIGIT}+)[{SPACE}-]([a-z]{{2}})([{SPACE}])"  # -> groups 1, 2, 3
BRAND_WORD = r"[a-z0-9*/+\-'’?!.,|&%®™ôèéü]+"
TWO_BRAND_WORDS = rf"{BRAND_WORD}[{SPACE}]{BRAND_WORD}"
LETTER_WORD = "[a-z]+"
WORD_TOKEN = rf"[{WORD}]{{2,}}"
DIGIT_TOKEN = rf"{DIGIT}+"
SEQUENCE_FILTERS = "!#()*,-./:;<=>?[\\]^_`{|}~\t\n"
STOP_WORDS = ("the", "a", "an", "is", "it", "this")

# ---- sizes and settings ----
HASH_BUCKETS = 2**27
MIN_DF = 2
NAME_TERMS = 50_000
DESCRIPTION_TERMS = 100_000
MAX_WORDS = 50_000
NAME_SEQUENCE = 10
DESCRIPTION_SEQUENCE = 75
HOLDOUT_FRACTION = 0.999
SAMPLE_FRACTION = 0.85
PRICE_FLOOR = 3.0
RIDGE_ALPHA = 0.5
RIDGE_ITERATIONS = 100
TREE_RATE = 0.45
TREE_DEPTH = 7
TREE_LEAVES = 31
TREE_MIN_ROWS = 20  # documented default of the tree learner
TREE_FEATURE_FRACTION = 0.9
TREE_ROUNDS = 1600
EMBEDDING_SIZE = 50
CODE_SIZES = {"brand_name": 10, "cat_1": 10, "cat_2": 10, "cat_3": 10, "item_condition": 5}
FILTERS = 20
KERNEL = 3
DENSE_SIZES = (512, 256, 128, 20)
EPOCH_RATES = (0.0015, 0.0011, 0.001, 0.0009, 0.0008)
SNAPSHOT_WEIGHTS = {3: 0.2, 4: 0.4, 2: 0.4}  # epoch (= sample seed) -> weight, in the order they are added up
BLEND_WEIGHTS = {"tree": 0.2, "linear": 0.4, "embedding": 0.4}
