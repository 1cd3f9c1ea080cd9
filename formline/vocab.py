"""Vocabulary of the event data. All tables here are fixed values that results depend on."""

from __future__ import annotations

# Event and description names.
STRIKEOUTS = ("strikeout", "strikeout_double_play")
WALKS = ("walk", "intent_walk")
NOT_APPEARANCES = (
    "caught_stealing_2b", "caught_stealing_3b", "caught_stealing_home", "pickoff_1b", "pickoff_2b", "pickoff_3b",
    "pickoff_caught_stealing_2b", "pickoff_caught_stealing_3b", "pickoff_caught_stealing_home",
    "stolen_base_2b", "stolen_base_3b", "stolen_base_home", "wild_pitch", "passed_ball", "other_out", "runner_double_play",
)
HITS = ("single", "double", "triple", "home_run")
WHIFFS = ("swinging_strike", "swinging_strike_blocked", "foul_tip")
CONTACTS = ("foul", "hit_into_play")
SWINGS = WHIFFS + CONTACTS
FLY_BALLS = ("fly_ball", "popup")

# Raw pitch codes to the types that are tracked; all other codes count in totals alone.
PITCH_TYPES = ("ff", "si", "fc", "sl", "st", "cu", "ch", "fs")
PITCH_CODES = {
    "FF": "ff", "FA": "ff", "SI": "si", "FT": "si", "FC": "fc", "SL": "sl", "SV": "sl",
    "ST": "st", "CU": "cu", "KC": "cu", "CS": "cu", "CH": "ch", "FS": "fs", "SF": "fs",
}

# Outs by event.
OUTS = {
    3: ("triple_play",),
    2: ("grounded_into_double_play", "double_play", "sac_fly_double_play", "strikeout_double_play", "runner_double_play"),
    1: (
        "field_out", "force_out", "sac_fly", "sac_bunt", "strikeout", "fielders_choice_out", "fielders_choice", "other_out", "batter_interference",
        "caught_stealing_2b", "caught_stealing_3b", "caught_stealing_home", "pickoff_1b", "pickoff_2b", "pickoff_3b",
        "pickoff_caught_stealing_2b", "pickoff_caught_stealing_3b", "pickoff_caught_stealing_home",
    ),
}

# Yearly constants of the fielding-independent estimators.
FIP_CONSTANTS = {2021: 3.170, 2022: 3.112, 2023: 3.255, 2024: 3.166, 2025: 3.135, 2026: 3.099}

# Thresholds.
HARD_HIT, BARREL, WEAK = 95.0, 6, 1
LEAST_APPEARANCES = 9
LEAST_OUTS = 9

# Teams, and other codes for them.
TEAM_IDS = {
    "ARI": 109, "ATL": 144, "BAL": 110, "BOS": 111, "CHC": 112, "CWS": 145, "CIN": 113, "CLE": 114, "COL": 115, "DET": 116,
    "HOU": 117, "KC": 118, "LAA": 108, "LAD": 119, "MIA": 146, "MIL": 158, "MIN": 142, "NYM": 121, "NYY": 147, "ATH": 133,
    "PHI": 143, "PIT": 134, "SD": 135, "SF": 137, "SEA": 136, "STL": 138, "TB": 139, "TEX": 140, "TOR": 141, "WSH": 120,
}
TEAM_ALIASES = {"AZ": "ARI", "CHW": "CWS", "KAN": "KC", "KCR": "KC", "OAK": "ATH", "SDP": "SD", "SFG": "SF", "TBR": "TB", "WAS": "WSH", "WSN": "WSH"}

# Home games away from the home park, by team and dates.
VENUE_OVERRIDES = {("TB", "2025-01-01", "2025-12-31"): "TB_steinbrenner"}

# Rates as pairs of counts, and what is averaged per start.
RATES = {
    "k_rate": ("K", "PA"), "bb_rate": ("BB", "PA"), "csw_rate": ("CSW", "Pitches"), "swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"),
    "ball_rate": ("Balls", "Pitches"), "cs_rate": ("CS", "Pitches"), "chase_rate": ("Chases", "OutZone"), "zone_rate": ("InZone", "Pitches"),
    "contact_rate": ("Contacts", "Swings"), "gb_rate": ("GB", "BIP"), "hr_rate": ("HR", "PA"),
    "xBA": ("xBA_num", "xBA_den"), "wOBA": ("wOBA_num", "wOBA_den"), "xwOBA": ("xwOBA_num", "wOBA_den"),
}
PHYSICS = ("velo", "spinrate", "ivb", "hb", "vaa")
RELEASE = ("extension", "rel_x", "rel_z", "rel_x_sd", "rel_z_sd")
MEANS = (*(f"{t}_{m}" for t in PITCH_TYPES for m in PHYSICS), *(f"{t}_usage_v{h}" for t in PITCH_TYPES for h in "RL"), *RELEASE)
RATE_WINDOWS, MEAN_WINDOWS = (5, 10, 20), (3, 5, 10)
FIP_COUNTS = ("HR", "BB", "HBP", "K", "FB", "Outs")
BATTER_EXTRAS = {"swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"), "chase_rate": ("Chases", "OutZone")}

# Statistics of the reliability study and their denominators.
RATE_STATS = ("K", "BB", "Whiffs", "HR", "Hits", "GB", "FB", "HBP", "BIP", "CS", "CSW", "Strikes", "Balls", "Outs", "Pitches", "Runs")
MEAN_STATS = (
    *(f"throws_{t}" for t in PITCH_TYPES if t != "fs"), "k_rate", *(f"{t}_{m}" for t in PITCH_TYPES if t != "fs" for m in PHYSICS),
    *(f"{t}_usage_v{h}" for t in PITCH_TYPES if t != "fs" for h in "RL"),
    "zone_rate", "swing_rate", "chase_rate", "zswing_rate", "contact_rate", "zcontact_rate", "ocontact_rate", "swstr_rate", "whiff_rate", *RELEASE, "FIP", "xFIP",
)
PITCH_PLAN = {
    ("Whiffs", "Pitches"): True, ("CSW", "Pitches"): True, ("CS", "Pitches"): True, ("Chases", "OutZone"): True, ("ZSwings", "InZone"): True,
    ("Contacts", "Swings"): True, ("ZContacts", "ZSwings"): True, ("Swings", "Pitches"): True, ("InZone", "Pitches"): True,
    **{(f"ff_{m}", "Pitches"): False for m in PHYSICS},
}
PA_PLAN = {(s, "PA"): True for s in ("K", "BB", "HR", "Hits", "HBP", "BIP")} | {("xBA_num", "xBA_den"): True, ("wOBA_num", "wOBA_den"): True, ("xwOBA_num", "wOBA_den"): True}

# Statistics of the stabilisation study with numerator, denominator, last target and step.
PITCHER_SPECS = {
    "k_rate": ("K", "PA", 1000, 25), "whiff": ("Whiffs", "Swings", 2500, 50), "swstr": ("Whiffs", "Pitches", 5000, 100), "ball": ("Balls", "Pitches", 5000, 100),
    "chase": ("Chases", "OutZone", 2500, 50), "csw": ("CSW", "Pitches", 5000, 100), "bb": ("BB", "PA", 1000, 25), "gb": ("GB", "BIP", 1000, 25), "hr_fb": ("HR", "FB", 400, 10),
}
BATTER_SPECS = {"k_rate": ("K", "PA", 1000, 25), "whiff": ("Whiffs", "Swings", 2000, 50), "swstr": ("Whiffs", "Pitches", 4000, 100), "chase": ("Chases", "OutZone", 2000, 50)}
# The same for every pitch type.
PITCH_TYPE_SPECS = {
    "whiff": ("Whiffs", "Swings", 1000, 25), "swstr": ("Whiffs", "Pitches", 2000, 50), "ball": ("Balls", "Pitches", 2000, 50), "csw": ("CSW", "Pitches", 2000, 50), "chase": ("Chases", "OutZone", 1000, 25),
    "weak_contact": ("WeakContact", "xBA_den", 400, 10), "hard_hit": ("HardHit", "EV_den", 400, 10), "barrel": ("Barrels", "xBA_den", 400, 10), "gb": ("GB", "BIP", 400, 10),
    "xBA": ("xBA_num", "xBA_den", 400, 10), "wOBA": ("wOBA_num", "wOBA_den", 400, 10), "xwOBA": ("xwOBA_num", "wOBA_den", 400, 10),
}

# Families of features that ablations add to a core, by name or by how names begin.
FAMILIES = {
    "pitcher_whiff": "whiff_rate_", "pitcher_swstr": "swstr_rate_", "pitcher_ball": "ball_rate_", "pitcher_gb": "gb_rate_",
    "batter_whiff": "opp_lineup_whiff", "batter_swstr": "opp_lineup_swstr",
}
# Column sets of the feature ablation as families, with the endings that are taken of them.
FEATURE_SETS = {
    "core": (),
    "pitcher_whiff": ("pitcher_whiff",),
    "pitcher_swstr": ("pitcher_swstr",),
    "pitcher_both": ("pitcher_whiff", "pitcher_swstr"),
    "batter_whiff": ("batter_whiff",),
    "batter_swstr": ("batter_swstr",),
    "batter_both": ("batter_whiff", "batter_swstr"),
    "pitcher_ball": ("pitcher_ball",),
    "pitcher_gb": ("pitcher_gb",),
    "preferred_raw": ("pitcher_swstr", "batter_whiff", "pitcher_ball", "pitcher_gb"),
    "compact_candidate": ("pitcher_whiff _P20", "pitcher_swstr _P20", "pitcher_ball _P20", "batter_whiff", "batter_swstr"),
    "all_candidates": None,
}
# Column sets of the window ablation, in the same form.
WINDOW_SETS = {
    "core": (),
    "whiff_P5": ("pitcher_whiff _P5",),
    "whiff_P10": ("pitcher_whiff _P10",),
    "whiff_P20": ("pitcher_whiff _P20",),
    "whiff_std": ("pitcher_whiff _std",),
    "whiff_P5_P10": ("pitcher_whiff _P5 _P10",),
    "swstr_P5": ("pitcher_swstr _P5",),
    "swstr_P10": ("pitcher_swstr _P10",),
    "swstr_P20": ("pitcher_swstr _P20",),
    "swstr_std": ("pitcher_swstr _std",),
    "swstr_P5_P10": ("pitcher_swstr _P5 _P10",),
    "ball_P5": ("pitcher_ball _P5",),
    "ball_P20": ("pitcher_ball _P20",),
    "ball_std": ("pitcher_ball _std",),
    "whiff_swstr_P20": ("pitcher_whiff _P20", "pitcher_swstr _P20"),
    "discipline_short": ("pitcher_whiff _P5", "pitcher_swstr _P5", "pitcher_ball _P5"),
    "discipline_short_long": ("pitcher_whiff _P5 _P10", "pitcher_swstr _P5 _P10", "pitcher_ball _P5 _std"),
}

# What a model may see.
METADATA = ("game_pk", "game_date", "season", "pitcher", "batter", "player_name", "pitcher_name", "batter_name", "home_team", "away_team", "opp_team", "p_throws", "stand", "bat_team", "opp_lineup_size", "is_initial_lineup")
FORBIDDEN_FEATURES = ("PA", "K", "Outs", "k_rate", "actual_k", "actual_outs", "actual_pa", "actual_tbf")
CONTEXT_FEATURES = ("is_home", "park_k_factor", "opp_lineup_k", "opp_lineup_k_vs_hand", "opp_lineup_whiff", "opp_lineup_swstr", "opp_lineup_chase")
LAGGED_FEATURE = r"(_P\d+|_std(?:_vL|_vR|_shrunk)?)$"
