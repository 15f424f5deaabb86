"""Fixed values that results depend on."""

from __future__ import annotations

# Sampling and window geometry.
RATE_HZ = 1000
CHANNELS = 4
HAND_CHANNELS = (0, 1, 2)
BICEP_CHANNEL = 3
WINDOW = 150
HOP = 25
FFT_SIZE = 256

# Classes, in the alphabetical order every probability vector uses.
GESTURES = ("fist", "hook_em", "open", "rest", "thumbs_up")
REST = "rest"
UNLABELED = "unlabeled"

# Spellings accepted per dialect, matched exactly.
ALIASES = (
    ("model", "rest", "rest"),
    ("model", "REST", "rest"),
    ("model", "fist", "fist"),
    ("model", "FIST", "fist"),
    ("model", "open", "open"),
    ("model", "OPEN", "open"),
    ("model", "hook_em", "hook_em"),
    ("model", "HOOK_EM", "hook_em"),
    ("model", "thumbs_up", "thumbs_up"),
    ("model", "THUMBS_UP", "thumbs_up"),
    ("console", "rest", "rest"),
    ("console", "fist", "fist"),
    ("console", "open", "open"),
    ("console", "hook-em", "hook_em"),
    ("console", "hookem", "hook_em"),
    ("console", "thumbs-up", "thumbs_up"),
    ("console", "thumbsup", "thumbs_up"),
)

# Command words, tried in this order, each by prefix.
COMMANDS = (
    "connect",
    "start_laptop_predict",
    "start_predict",
    "start",
    "calibrate",
    "stop",
    "disconnect",
)
# State entered by each command that starts an activity.
ACTIVE_STATES = {
    "start": "STREAMING",
    "start_predict": "PREDICTING",
    "start_laptop_predict": "LAPTOP_PREDICT",
    "calibrate": "CALIBRATING",
}

# Features of one channel, in vector order.
CHANNEL_FEATURES = (
    "rms", "wl", "zc", "ssc", "mav", "var", "iemg", "wamp",
    "ar1", "ar2", "ar3", "ar4",
    "mnf", "mdf", "pkf", "mnp", "bp0", "bp1", "bp2", "bp3",
)
BASIC_FEATURES = ("rms", "wl", "zc", "ssc")
AMPLITUDE_FEATURES = ("rms", "wl", "mav", "iemg")
PAIR_FEATURES = ("corr", "lrms", "cov")
POWER_BANDS = ((20, 80), (80, 150), (150, 250), (250, 450))
CROSS_SPECTRUM_BANDS = ((0, 62), (62, 125), (125, 187), (187, 250), (250, 375), (375, 500))

# Thresholds as a share of the window's RMS.
ZC_SHARE = 0.1
SSC_SHARE = 0.1

# Prompting and labelling.
HOLD_SEC, REST_SEC, REPETITIONS = 3.0, 2.0, 3
LABEL_SHIFT_SEC = 0.150
FORWARD_SHIFT_MS = 100
TRANSITION_START_MS, TRANSITION_END_MS = 200, 150
ONSET_FACTOR, ONSET_SEARCH_MS, ONSET_BASELINE_MS, ONSET_FALLBACK_SEC = 2.0, 2000, 200, 0.3

# Smoothing.
EMA_KEEP, ENTER, HOLD, REJECT, VOTES, DEBOUNCE = 0.70, 0.70, 0.25, 0.40, 5, 3

# Proportional channel.
FLEX_MULTIPLIER, FLEX_HYSTERESIS = 2.5, 1.3
ANGLE_REST, ANGLE_FLEX = 60.0, 140.0
LEVEL_KEEP, DEADZONE, SLEW_DEG, WRITE_DEG = 0.80, 0.05, 6.0, 0.5
BICEP_SAMPLES = 50

# Finger joints with their angle limits in degrees: (joint, extended, flexed).
JOINT_LIMITS = (
    ("thumb", 65.0, 155.0),
    ("index", 45.0, 155.0),
    ("middle", 45.0, 180.0),
    ("ring", 30.0, 165.0),
    ("pinky", 25.0, 150.0),
)
# Joints a gesture keeps extended; all others are flexed. Rest is midway on every joint.
EXTENDED = {
    "open": ("thumb", "index", "middle", "ring", "pinky"),
    "fist": (),
    "hook_em": ("index", "pinky"),
    "thumbs_up": ("thumb",),
}
DUTY_MIN, DUTY_MAX = 110, 510
