"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour being
reproduced (keyword tables, merchant map, benchmarks, tips, column synonyms,
regex patterns).  They are listed plainly and in their natural order; table
order matters where noted (first strict maximum wins in keyword scoring, first
synonym found wins in column detection).  Operators take them as parameters,
so callers can pass their own tables.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Column synonyms per standard name; list order is search order.
COLUMN_SYNONYMS = {
    "description": ["description", "narration", "particulars", "details", "transaction details",
                    "remarks", "description of transaction", "txn description", "particular"],
    "amount": ["amount", "debit", "credit", "transaction amount", "txn amount", "value"],
    "category": ["category", "type", "classification"],
    "date": ["date", "transaction date", "txn date", "value date"],
    "merchant": ["merchant", "merchant name", "payee", "recipient"],
    "transaction_type": ["type", "transaction type", "txn type", "debit/credit", "dr/cr"],
}

# Shorter synonym lists used by the upload profile screen.
UPLOAD_PROFILE_SYNONYMS = {
    "description": ["description", "narration", "particulars", "details"],
    "amount": ["amount", "debit", "credit"],
    "category": ["category"],
    "date": ["date"],
}
UPLOAD_DESCRIPTION_NAMES = ["description", "narration", "details"]

# Columns required for training, and accepted file extensions.
REQUIRED_COLUMNS = ["description", "amount", "category"]
SUPPORTED_FORMATS = [".csv", ".xlsx", ".xls"]

# Tokens that a pandas CSV read turns into a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Keywords of the label cleaner / label repair jobs, in tie order.
CLEANER_KEYWORDS = {
    "food": ["food", "swiggy", "zomato", "restaurant", "cafe", "coffee", "lunch", "dinner",
             "pizza", "burger", "meal", "snack", "dominos", "starbucks", "mcdonalds", "kfc"],
    "transport": ["uber", "ola", "taxi", "cab", "bus", "train", "metro", "ride", "ticket",
                  "travel", "trip", "irctc", "redbus"],
    "shopping": ["amazon", "flipkart", "shop", "purchase", "store", "mart", "clothes",
                 "shoes", "electronics", "fashion", "mall", "bookmyshow", "pvr"],
    "grocery": ["grocery", "supermarket", "vegetable", "fruit", "milk", "bread", "bigbasket",
                "grofers", "dmart", "reliance smart", "blinkit", "zepto"],
    "bills": ["bill", "electricity", "water", "gas", "internet", "phone", "recharge",
              "payment", "bescom", "airtel", "jio", "msedcl"],
    "subscription": ["netflix", "prime", "spotify", "subscription", "membership",
                     "disney", "hotstar", "streaming", "premium"],
    "fuel": ["petrol", "diesel", "cng", "fuel", "gas", "pump", "indianoil", "bpcl", "hpcl", "shell"],
    "entertainment": ["movie", "concert", "gaming", "steam", "playstation", "xbox", "insider"],
}

# Keywords of the feature builder (a different table from the cleaner's).
FEATURE_KEYWORDS = {
    "food": ["food", "restaurant", "cafe", "coffee", "lunch", "dinner", "breakfast",
             "pizza", "burger", "sandwich", "meal", "snack", "swiggy", "zomato",
             "dominos", "starbucks", "mcdonalds", "kfc", "subway", "taco", "bakery"],
    "transport": ["uber", "ola", "taxi", "cab", "bus", "train", "flight", "metro",
                  "transport", "ride", "travel", "journey", "trip", "ticket", "fuel",
                  "petrol", "diesel", "auto", "rickshaw"],
    "shopping": ["amazon", "flipkart", "shop", "purchase", "buy", "store", "mart",
                 "clothes", "shoes", "electronics", "gadgets", "fashion", "mall",
                 "retail", "online", "order", "delivery"],
    "groceries": ["grocery", "supermarket", "vegetable", "fruit", "milk", "bread",
                  "rice", "wheat", "flour", "sugar", "oil", "dairy", "meat", "fish",
                  "bigbasket", "grofers", "dmart", "kirana"],
    "bills": ["bill", "electricity", "water", "gas", "internet", "phone", "mobile",
              "recharge", "payment", "utility", "broadband", "wifi", "cable", "tv",
              "subscription", "rent", "emi"],
    "subscription": ["netflix", "prime", "spotify", "subscription", "monthly",
                     "annual", "membership", "disney", "hulu", "streaming",
                     "premium", "plan"],
    "fuel": ["petrol", "diesel", "cng", "fuel", "gas", "station", "pump",
             "tank", "fill", "refill", "hp", "bp", "indian oil"],
    "other_expenses": ["medical", "doctor", "pharmacy", "medicine", "gym", "fitness",
                       "movie", "entertainment", "gift", "donation", "charity",
                       "insurance", "tax", "legal", "consulting"],
}

# Merchant name -> category (exact, case-sensitive lookup).
MERCHANT_CATEGORY = {
    "Swiggy": "food",
    "Zomato": "food",
    "Dineout": "food",
    "Uber": "transport",
    "Ola": "transport",
    "RedBus": "transport",
    "IRCTC": "transport",
    "MakeMyTrip": "transport",
    "Amazon": "shopping",
    "Flipkart": "shopping",
    "BookMyShow": "shopping",
    "PVR": "shopping",
    "Netflix": "subscription",
    "Prime Video": "subscription",
    "Disney+": "subscription",
    "Spotify": "subscription",
    "Apple Music": "subscription",
    "IndianOil": "fuel",
    "BPCL": "fuel",
    "HPCL": "fuel",
    "Shell": "fuel",
    "BESCOM": "bills",
    "TSSPDCL": "bills",
    "MSEDCL": "bills",
    "Airtel": "bills",
    "JioFiber": "bills",
    "ACT Fibernet": "bills",
    "Jio": "bills",
    "Vi": "bills",
    "Steam": "entertainment",
    "PlayStation": "entertainment",
    "Xbox": "entertainment",
    "BigBasket": "grocery",
    "Blinkit": "grocery",
    "Zepto": "grocery",
    "Reliance Smart": "grocery",
    "D-Mart": "grocery",
    "Apollo Pharmacy": "grocery",
    "1mg": "grocery",
    "Netmeds": "grocery",
}

# Category spending benchmarks: (ideal share, warning share) of the reference amount.
BENCHMARKS = {
    "food": (0.15, 0.25),
    "transport": (0.10, 0.20),
    "shopping": (0.10, 0.20),
    "groceries": (0.15, 0.20),
    "bills": (0.25, 0.35),
    "subscription": (0.05, 0.10),
    "fuel": (0.05, 0.10),
    "other_expenses": (0.10, 0.15),
}

# Per-category saving tips.
CATEGORY_TIPS = {
    "food": "Try meal prepping or cooking at home more often. Use discount apps.",
    "transport": "Consider using public transport, carpooling, or biking for short distances.",
    "shopping": "Wait 24 hours before making non-essential purchases. Look for sales.",
    "groceries": "Buy in bulk, use store brands, and plan meals to reduce waste.",
    "bills": "Negotiate with providers or switch to cheaper plans. Check for unused services.",
    "subscription": "Cancel unused subscriptions. Share family plans where possible.",
    "fuel": "Use fuel rewards programs, maintain tire pressure, and plan efficient routes.",
    "other_expenses": "Track these expenses carefully - they often contain hidden leaks.",
}

# Merchant extraction patterns, applied to the upper-cased description in this order.
UPI_PATTERN = r"UPI[/\-]([^/\s]+)"
UPI_SUFFIX_PATTERN = r"@.*$"
POS_PATTERN = r"POS[-\s]*(DEBIT)?[-\s]*([A-Z][A-Z\s]+)"
BANK_TRANSFER_PATTERN = r"(?:IMPS|NEFT|RTGS)[-\s]*\d*[-\s]*([A-Z][A-Z\s]+)"
MERCHANT_SKIP_WORDS = ["UPI", "POS", "IMPS", "NEFT", "RTGS", "NACH", "ECS", "ATM", "CASH"]

# Transaction modes in search order: (search key, mode label).
TRANSACTION_MODES = [("upi", "UPI"), ("pos", "POS"), ("imps", "IMPS"), ("neft", "NEFT"),
                     ("rtgs", "RTGS"), ("nach", "NACH"), ("ecs", "ECS"), ("atm", "ATM"),
                     ("cash", "CASH")]

# Insight rule thresholds.
FREQUENT_SMALL_MIN_COUNT = 10      # strictly more than
FREQUENT_SMALL_MAX_MEAN = 100.0    # strictly less than
FREQUENT_SMALL_MIN_TOTAL = 500.0   # strictly more than
FREQUENT_SMALL_SAVINGS = 0.3
SUBSCRIPTION_MIN_COUNT = 5         # strictly more than
SUBSCRIPTION_SAVINGS = 0.4
ANOMALY_MIN_COUNT = 3
ANOMALY_Z = 2.5
TOP_MERCHANTS = 5
SEVERITY_ORDER = ["high", "medium", "low"]

# Fixed amount bins of the compact feature set: <100, <500, <1000, else.
AMOUNT_BIN_EDGES = [100.0, 500.0, 1000.0]
AMOUNT_BIN_NAMES = ["amt_small", "amt_medium", "amt_large", "amt_xl"]

# Message texts of the insight records (the currency sign is part of the text).
CURRENCY = "₹"
# ------------------------------------------------------------ end FIXED VALUES

# ------------------------------------------------------------ FIXED VALUES
# Model settings (Spark parameter names; ``penalty`` is the inverse strength C).
SINGLE_MODEL_PARAMS = {
    "random_forest": {"numTrees": 100, "maxDepth": 10},
    "logistic_regression": {"maxIter": 1000, "penalty": 1.0},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3},
    "naive_bayes": {"modelType": "multinomial"},
    "svm": {"penalty": 1.0},
    "decision_tree": {"maxDepth": 15, "minInstancesPerNode": 5},
}
# The bake-off set is fitted with balanced class weights.
BAKEOFF_PARAMS = {
    "logistic_regression": {"maxIter": 2000, "penalty": 1.0},
    "random_forest": {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 2,
                      "minRowsToSplit": 5},
    "decision_tree": {"maxDepth": 15, "minInstancesPerNode": 5, "minRowsToSplit": 10},
    "svm": {"penalty": 0.5},
}
# Members of the soft vote.
VOTING_PARAMS = {
    "logistic_regression": {"maxIter": 2000, "penalty": 1.0},
    "random_forest": {"numTrees": 200, "maxDepth": 30},
}
# -------------------------------------------------------- end FIXED VALUES
