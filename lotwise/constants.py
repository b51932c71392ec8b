"""They must equal the published rules for results to agree."""

# Output classes of the item classifier, in output order; every class but the first is a defect.
CLASSES = ["good", "dark", "insect", "broken", "unhulled", "other_defect"]
DEFECTS = CLASSES[1:]
KINDS = CLASSES + ["defect_untyped"]

# Sampling weight of each label kind.
KIND_WEIGHTS = {
    "good": 0.40, "dark": 0.11, "insect": 0.11, "broken": 0.11, "unhulled": 0.11,
    "other_defect": 0.06, "defect_untyped": 0.10,
}

# Call codes.
GOOD, DEFECT, UNSURE = 0, 1, 2

# Lot verdict.
Z95 = 1.96
CLEAN_MAX = 0.05
MANY_MIN = 0.2
MAX_UNSURE_FRAC = 0.15
IMPLAUSIBLE_DEFECT_FRAC = 0.6
MAX_HANDFULS = 3

# Two-threshold call.
T_GOOD = 0.55
T_DEFECT = 0.91
T_CANDIDATES = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75]
T_FALLBACK = 0.75
TARGET_ACCURACY = 0.90
MIN_ANSWERED = 30

# Photo checks.
MIN_ITEMS, MAX_ITEMS = 20, 160
DARK_LUMA = 90.0
BLUR_VAR = 15.0
TOUCH_MIN, TOUCH_FRAC = 2, 0.08

# Component table.
MIN_AREA, BIG_P90_FRAC, SMALL_MED_FRAC, TOUCH_AREA_X = 30, 0.15, 0.25, 1.8

# Item quality against its own photo.
AREA_REL = (0.4, 2.5)
EDGE_PX = 2
MIN_SHEET_LUMA = 120.0

# Touching rule.
TOUCH_RULE = {
    "area_x": 1.6, "min_solidity": 0.8, "min_fill": 0.85, "max_elong": 2.2,
    "single_solidity": 0.93, "single_fill": 0.93, "min_singles": 5,
}

# Colour rule.
COLOUR_RULE = {
    "dark_v": 0.3, "white_s": 0.15, "white_v": 0.6, "hue_min": 26, "hue_max": 62, "sat_max": 0.66,
    "max_off": 0.5, "max_dark": 0.6, "max_blob": 0.08,
}

# Dark-lot rule.
DARK_LOT = {
    "min_shaped": 0.8, "elong_min": 1.15, "elong_max": 2.2, "max_area_cv": 0.6,
    "dark_v": 0.3, "hue_min": 26, "hue_max": 62, "max_dark_sat": 0.42,
}

SHEET_TARGET = 235.0
NEAR_DUP_COS = 0.998
UNUSUAL_Z = 3.5
KNN_K = 5

# Channel perturbations of a colour: per-channel factors (clipped to 255).
PERTURBATIONS = {
    "darker": (0.6, 0.6, 0.6),
    "brighter": (1.3, 1.3, 1.3),
    "warm": (1.0, 0.85, 0.65),
    "cool": (0.75, 0.9, 1.0),
}
EXPOSURE_GAIN = (0.95, 0.86, 0.72)
EXPOSURE_GAMMA = 1.15

# Local head.
HEAD_PER_CLASS = 10
HEAD_MAX_LOO_ERROR = 0.10
HEAD_FORMAT = "local-head/1"

# Slip text.
SLIP_MAX = 70
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
SLIP_TAG = "فحص ذاتي مش تصنيف"
SLIP_UNSURE = "مش متأكد"
