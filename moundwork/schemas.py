"""Column types of the domain tables, as read from files or produced by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
}


def _struct(text: str) -> T.StructType:
    """Fields written as ``name type [not null]``, separated by commas (needs no session)."""
    fields = []
    for part in text.split(","):
        name, kind, *rest = part.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


PITCHERS = _struct(
    "pitcher_id int not null, name string not null, team string not null, role string not null, "
    "baseline_velocity double, baseline_spin_rate int, injury_risk_profile string"
)

PITCHES = _struct(
    "game_date date not null, pitcher_id int not null, pitch_type string not null, "
    "release_speed double, release_spin_rate int, pitch_number int not null, at_bat_id bigint not null"
)

PITCHES_EXTENDED = T.StructType(
    PITCHES.fields
    + _struct("release_pos_x double, release_pos_z double, release_extension double, season int").fields
)

STATCAST_RAW = _struct(
    "game_date string, pitcher bigint, batter bigint, events string, description string, "
    "pitch_type string, release_speed double, release_spin_rate double, release_pos_x double, "
    "release_pos_z double, release_extension double, at_bat_number bigint, pitch_number int, "
    "player_name string"
)

APPEARANCES = _struct(
    "game_date date not null, pitcher_id int not null, pitches_thrown int not null, avg_vel double, "
    "avg_spin int, vel_std double, spin_std int, outs_recorded int, innings_pitched double"
)

INJURIES = _struct(
    "pitcher_id int not null, il_start date not null, il_end date, stint_type string not null"
)

INJURY_RECORDS = _struct(
    "pitcher_id string, pitcher_name string, team string, injury_date date, injury_type string, "
    "injury_location string, severity string, expected_return date, actual_return date, "
    "source string, url string, notes string, confidence_score double, data_quality string, "
    "raw_text string, created_at timestamp, updated_at timestamp"
)

PITCHER_MAPPING = _struct(
    "name string, team string, mlb_id string, espn_id string, rotowire_id string, spotrac_id string"
)

# Union of the two published feature-snapshot layouts.
FEATURE_SNAPSHOTS = _struct(
    "pitcher_id int not null, as_of_date date not null, roll21d_pitch_count int, "
    "roll21d_avg_vel double, roll21d_vel_decline double, roll21d_appearances int, "
    "roll7d_pitch_count int, roll7d_avg_vel double, roll7d_vel_decline double, "
    "roll7d_appearances int, roll3d_pitch_count int, roll3d_avg_vel double, "
    "roll3d_appearances int, roll3g_pitch_count int, roll14d_pitch_count int, "
    "avg_vel_7d double, vel_drop_vs_30d double, avg_spin_7d double, spin_drop_vs_30d double, "
    "rest_days int, vel_trend_slope double, days_since_last_appearance int, "
    "workload_intensity double, fatigue_score double, label_injury_within_7d boolean, "
    "label_injury_within_14d boolean, label_injury_within_21d boolean, data_completeness string"
)

PITCH_EVENTS = _struct(
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)

TABLES = {
    "pitchers": PITCHERS,
    "pitches": PITCHES,
    "appearances": APPEARANCES,
    "injuries": INJURIES,
    "injury_records": INJURY_RECORDS,
    "pitcher_mapping": PITCHER_MAPPING,
    "feature_snapshots": FEATURE_SNAPSHOTS,
}

RISK_LEVELS = ("low", "medium", "high")
TREND_DIRECTIONS = ("increasing", "decreasing", "stable")
