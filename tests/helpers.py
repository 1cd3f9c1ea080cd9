"""Small frames of pitches, starts and games."""

from datetime import date

PITCH = {
    "game_pk": ("long", 1), "game_date": ("date", date(2024, 5, 1)), "game_year": ("int", 2024), "player_name": ("string", "Doe, Jo"), "pitcher": ("long", 10), "batter": ("long", 20),
    "stand": ("string", "R"), "p_throws": ("string", "R"), "home_team": ("string", "HOM"), "away_team": ("string", "AWY"), "inning": ("int", 1), "inning_topbot": ("string", "Top"),
    "at_bat_number": ("int", 1), "pitch_number": ("int", 1), "pitch_type": ("string", "FF"), "type": ("string", "S"), "description": ("string", "called_strike"), "events": ("string", None), "bb_type": ("string", None),
    "release_speed": ("double", 95.0), "release_spin_rate": ("double", 2300.0), "pfx_x": ("double", 0.5), "pfx_z": ("double", 1.0), "vy0": ("double", -138.0), "vz0": ("double", -5.0), "ay": ("double", 30.0), "az": ("double", -15.0),
    "release_extension": ("double", 6.5), "release_pos_x": ("double", -1.0), "release_pos_z": ("double", 6.0), "launch_speed": ("double", None), "launch_angle": ("double", None), "launch_speed_angle": ("int", None),
    "estimated_ba_using_speedangle": ("double", None), "estimated_woba_using_speedangle": ("double", None), "woba_value": ("double", None), "woba_denom": ("int", None), "bat_score": ("int", 0), "post_bat_score": ("int", 0), "zone": ("int", 5),
}


def frame(spark, rows, columns):
    """rows as dicts over columns {name: (type, default)}."""
    schema = ", ".join(f"{c} {t}" for c, (t, _) in columns.items())
    unknown = {k for r in rows for k in r} - set(columns)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(r.get(c, d) for c, (_, d) in columns.items()) for r in rows], schema)


def pitch_frame(spark, *rows):
    return frame(spark, rows, PITCH)


START = {
    "pitcher": ("long", 1), "game_pk": ("long", 1), "game_date": ("date", date(2024, 4, 1)), "K": ("long", 5), "PA": ("long", 20), "Pitches": ("long", 90), "ff_velo": ("double", 95.0),
    "HR": ("long", 1), "BB": ("long", 2), "HBP": ("long", 0), "FB": ("long", 5), "Outs": ("long", 15), "lg_hr_fb_prior": ("double", 0.1), "player_name": ("string", "Doe, Jo"),
}

GAME = {
    "batter": ("long", 1), "game_pk": ("long", 1), "game_date": ("date", date(2024, 4, 1)), "PA": ("long", 4), "K": ("long", 1), "PA_vL": ("long", 0), "K_vL": ("long", 0), "PA_vR": ("long", 4), "K_vR": ("long", 1),
    "Whiffs": ("long", 2), "Swings": ("long", 8), "Pitches": ("long", 16), "Chases": ("long", 2), "OutZone": ("long", 8),
}
