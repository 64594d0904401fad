"""Word lists, thresholds and labels that decide results."""

# --- fixed values -----------------------------------------------------------

STATE_CACHE_VERSION = 5

BANNER_NOT_SHOWN = "PREVIOUS PLAY BANNER NOT SHOWN"

SCORE_STEPS = (0, 1, 2, 3, 6, 7, 8)
PAT_REACH = 12
SCORE_LOOKAHEAD = 3

CONSENSUS_TOKENS = (
    "PA", "HB", "COVER", "TAMPA", "BLAST", "DIVE", "STRETCH",
    "SAIL", "CLOUD", "SKY", "ZONE", "FIRE", "DOG", "BASE",
)
QUALITY_TOKENS = CONSENSUS_TOKENS + ("CURL", "POST")

RUN_WORDS = ("HB", "DIVE", "STRETCH", "BASE", "ZONE", "POWER", "COUNTER")
PASS_WORDS = ("PA ", "POST", "SAIL", "CURL", "DIG", "SLANT", "VERT", "FLAT")

FORMATION_FIXES = (
    ("HORMAL", "NORMAL"),
    ("CIOSE", "CLOSE"),
    ("STOT", "SLOT"),
    ("YOFFCLOSE", "Y OFF CLOSE"),
)
FORMATION_FAMILIES = (
    "GUN", "SINGLEBACK", "PISTOL", "SHOTGUN", "I FORM", "STRONG", "WEAK",
)
DASHED_FAMILIES = ("Gun", "Singleback", "Pistol", "Shotgun", "Strong", "Weak")
UPPERCASE_FORMATION_WORDS = ("TE",)

STATUS_SCORES = {
    "verified": 1.0,
    "verified_fuzzy": 0.9,
    "special_state": 1.0,
    "not_applicable": 1.0,
    "banner_not_shown": 1.0,
    "unverified": 0.2,
    "unreadable": 0.0,
    "catalog_unavailable": 0.0,
}
UNSUPPORTED_STATUSES = ("unverified", "unreadable", "catalog_unavailable")

FUZZY_ACCEPT = 0.90
FUZZY_ACCEPT_WITH_MARGIN = 0.80
FUZZY_MARGIN = 0.08

SPECIAL_TEAMS_PHRASES = (
    "SPECIAL TEAM", "KICKOFF", "FIELD GOAL", "PUNT", "FAKE FG", "FAKE PUNT",
)

RESERVED_CHANNEL_PATHS = (
    "directory", "downloads", "jobs", "p", "search",
    "settings", "subscriptions", "turbo", "videos", "wallet",
)

REQUIRED_PLAY_FIELDS = (
    "quarter", "game_clock", "away_team", "home_team",
    "possession_team", "play_type", "result",
)
LOW_CONFIDENCE = 0.7

CALIBRATED_FIELDS = (
    "stream_side", "possession_team", "field_side", "quarter",
    "game_clock_bucket", "away_team", "away_score", "home_team", "home_score",
    "down", "distance", "yard_line", "personnel", "formation",
    "previous_offensive_play_call", "previous_defensive_play_call",
    "offensive_play_call", "defensive_play_call", "play_type",
    "yards_gained", "result", "possession_change", "end_down_distance",
    "end_yard_line", "end_possession_team",
)
LOOSE_TEXT_FIELDS = (
    "formation", "previous_offensive_play_call", "previous_defensive_play_call",
    "offensive_play_call", "defensive_play_call", "result",
)
ALIGNMENT_WEIGHTS = {
    "quarter": 1.0,
    "away_score": 2.0,
    "home_score": 2.0,
    "down": 4.0,
    "distance": 3.0,
    "yard_line": 4.0,
    "offensive_play_call": 3.0,
    "defensive_play_call": 3.0,
}
ALIGNMENT_GAP = -3.0

BOUNDARY_THRESHOLD = 18.0
BOUNDARY_GAP = 2

RESCAN_SECONDS = 12.0

DEFAULT_REGIONS = {
    "scoreboard": (0.10, 0.00, 0.80, 0.17),
    "play_call_banner": (0.20, 0.72, 0.60, 0.20),
}

PLAY_COLUMNS = (
    "play_number", "start_timestamp_seconds", "end_timestamp_seconds",
    "quarter", "game_clock", "away_team", "away_score", "home_team",
    "home_score", "down", "distance", "down_distance", "yard_line_observed",
    "yard_line", "yard_line_provenance", "stream_side",
    "possession_team_observed", "possession_team",
    "possession_team_provenance", "field_side_observed", "field_side",
    "field_side_provenance", "personnel", "formation_observed", "formation",
    "formation_provenance", "previous_offensive_play_call",
    "previous_defensive_play_call", "previous_play_banner_shown",
    "offensive_play_call_ocr", "defensive_play_call_ocr",
    "offensive_play_call_evidence_count", "defensive_play_call_evidence_count",
    "offensive_play_call_evidence", "defensive_play_call_evidence",
    "previous_play_heading_evidence", "offensive_play_call_validation",
    "defensive_play_call_validation", "offensive_play_call_catalog_match",
    "defensive_play_call_catalog_match", "offensive_play_call_catalog_url",
    "defensive_play_call_catalog_url", "offensive_play_call",
    "defensive_play_call", "play_type", "result", "yards_gained",
    "possession_change", "end_down_distance", "end_yard_line",
    "situation_confidence", "call_confidence", "result_confidence",
    "overall_confidence", "situation_provenance", "call_provenance",
    "result_provenance", "transition_evidence", "description",
)

# ----------------------------------------------------------------------------
