"""Table schemas. Every column is nullable except the keys."""

FRAMES = """
    game_id string not null, frame_index bigint not null, timestamp_seconds double,
    quarter int, game_clock string, down int, distance int, special_state string,
    yard_line int, field_side string, stream_side string, personnel string,
    formation string, away_team string, home_team string, possession_team string,
    away_score int, home_score int, previous_play_banner_shown boolean,
    prev_def_call string, prev_off_call string
"""

READINGS = """
    game_id string not null, frame_index bigint not null, timestamp_seconds double,
    quarter_text string, clock_text string, down_distance_text string, yard_text string,
    away_score_text string, home_score_text string, away_team_text string,
    home_team_text string, defense_header_text string, defense_formation_text string,
    defense_personnel_text string, offense_formation_text string, prev_off_text string,
    prev_def_text string, heading_text string, panel_dark_ratio double,
    panel_edge_density double, possession_away_ratio double,
    possession_home_ratio double, edge_density double, dark_ratio double,
    bright_ratio double, diff_score double, field_side_row_counts array<int>
"""

CATALOG = """
    side string, unit string, formation_family string, formation string,
    formation_slug string, play_name string, play_slug string, play_type string,
    team_count int, source_url string, pos bigint
"""

OBSERVATIONS = """
    game_id string not null, timestamp_seconds double, off_text string,
    def_text string, heading string, panel_visible boolean
"""

LABELS = """
    game_id string, play_number int, stream_side string, quarter int,
    clock_bucket string, away_team string, away_score int, home_team string,
    home_score int, possession_team string, field_side string, yard_line int,
    down int, distance int, distance_label string, personnel string,
    formation string, previous_offensive_play_call string,
    previous_defensive_play_call string, offensive_play_call string,
    defensive_play_call string, play_type string, yards_gained int, result string,
    end_down int, end_distance int, end_distance_label string,
    end_field_side string, end_yard_line int, end_away_score int,
    end_home_score int, end_possession_team string, possession_change boolean,
    notes string
"""

JOBS = """
    stream_id string, channel string, title string, started_at string,
    detected_at string, status string
"""

EMBEDS = """
    array<struct<url: string, title: string, description: string,
                 author_url: string, fields: array<struct<value: string>>>>
"""
