"""Event-level columns: roles, outcomes, attribution, situation flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derive import bounded, derive, first_match, flag, or0

# Outcome labels by priority; the first flag equal to 1 wins.
OUTCOME_FLAGS = (
    ("rush_touchdown", "rush_td"),
    ("pass_touchdown", "pass_td"),
    ("interception", "interception"),
    ("fumble", "fumble"),
    ("sack", "sack"),
    ("qb_spike", "qb_spike"),
    ("qb_kneel", "qb_kneel"),
    ("penalty", "penalty"),
)
# Fixed values: (flag, credited player) pairs by priority.
CREDIT_PAIRS = (
    ("rush_touchdown", "rusher_player_id"),
    ("pass_touchdown", "receiver_player_id"),
    ("kickoff_return_touchdown", "kickoff_returner_player_id"),
    ("punt_return_touchdown", "punt_returner_player_id"),
    ("interception_return_touchdown", "interception_player_id"),
    ("fumble_return_touchdown", "fumble_recovery_1_player_id"),
    ("return_touchdown", "returner_player_id"),
)


def is_one(name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0)) == 1


def with_outcome(df: DataFrame, out: str = "play_outcome") -> DataFrame:
    """One outcome label per event; absent flag columns never match."""
    have = set(df.columns)

    def on(name: str) -> Column:
        return is_one(name) if name in have else F.lit(False)

    rules = [(on(name), label) for name, label in OUTCOME_FLAGS]
    rules += [
        (on("pass") & on("complete_pass"), "pass_complete"),
        (on("pass") & on("incomplete_pass"), "pass_incomplete"),
        (on("pass"), "pass"),
        (on("rush"), "rush"),
    ]
    return df.withColumn(out, first_match(rules, "other"))


def with_role_indicators(df: DataFrame) -> DataFrame:
    """0/1 attempt, completion, reception, target and carry.

    An official indicator is used where the feed has it, else it is inferred from the flags.
    """
    have = set(df.columns)

    def official(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).cast("int")

    def inferred(player: str, kind: str) -> Column:
        return flag(F.col(player).isNotNull() & is_one(kind)) if {player, kind} <= have else F.lit(0)

    attempt = official("pass_attempt") if "pass_attempt" in have else inferred("passer_player_id", "pass")
    if "complete_pass" in have:
        completion = official("complete_pass")
    elif {"pass", "incomplete_pass"} <= have:
        completion = flag(is_one("pass") & ~is_one("incomplete_pass"))
    else:
        scored = is_one("pass_touchdown") if "pass_touchdown" in have else F.lit(False)
        gained = F.col("passing_yards").isNotNull() if "passing_yards" in have else F.lit(False)
        completion = flag(scored | gained)
    receiver = F.col("receiver_player_id").isNotNull() if "receiver_player_id" in have else F.lit(False)
    carry = official("rush_attempt") if "rush_attempt" in have else inferred("rusher_player_id", "rush")
    reception = official("reception") if "reception" in have else flag(receiver & (completion == 1))
    return df.withColumns(
        {
            "pass_attempt": attempt,
            "completion": completion,
            "reception": reception,
            "target": flag(receiver & (attempt > 0)),
            "carry": carry,
        }
    )


def with_masked_yards(df: DataFrame) -> DataFrame:
    """Yards by kind from ``yards_gained``; NULL where the event is of another kind."""
    have = set(df.columns)
    kinds = (("rushing_yards", "rush"), ("passing_yards", "pass"), ("receiving_yards", "pass"))
    columns = {
        name: F.when(is_one(kind), F.col("yards_gained"))
        for name, kind in kinds
        if name not in have and {"yards_gained", kind} <= have
    }
    return df.withColumns(columns) if columns else df


def with_credit(df: DataFrame, pairs: Sequence[tuple[str, str]] = CREDIT_PAIRS, given: str = "td_player_id") -> DataFrame:
    """Credited player: the given id, else the player of the first raised flag that names one."""
    have = set(df.columns)
    options = [F.col(given)] if given in have else []
    options += [F.when(is_one(f), F.col(p)) for f, p in pairs if {f, p} <= have]
    credited = F.coalesce(*options) if options else F.lit(None).cast("string")
    return df.withColumns({"touchdown_player_id": credited, "touchdown": flag(credited.isNotNull())})


def with_zone_usage(df: DataFrame) -> DataFrame:
    """Targets and carries in the red zone and in goal-to-go situations."""
    have = set(df.columns)
    zone = (F.col("yardline_100").cast("double") <= 20) if "yardline_100" in have else F.lit(False)
    goal = is_one("goal_to_go") if "goal_to_go" in have else F.lit(False)
    return df.withColumns(
        {f"{name}_{act}": flag(is_one(act) & cond) for name, cond in (("red_zone", zone), ("goal_to_go", goal)) for act in ("target", "carry")}
    )


def with_participants(df: DataFrame, out: str = "players_involved") -> DataFrame:
    """``PASSER:x | RUSHER:y`` of the named parties, NULL when nobody is named."""
    have = set(df.columns)
    parts = [
        F.concat(F.lit(f"{role.upper()}:"), F.col(f"{role}_player_name"))
        for role in ("passer", "rusher", "receiver")
        if f"{role}_player_name" in have
    ]
    text = F.concat_ws(" | ", *parts)
    return df.withColumn(out, F.when(F.length(text) > 0, text))


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Numeric coercion: score and clocks default to 0, probabilities clip to [0, 1]."""
    zero = ("score_differential", "game_seconds_remaining", "half_seconds_remaining", "quarter_seconds_remaining", "ydstogo")
    specs = [(n, [n], F.coalesce(F.col(n).cast("double"), F.lit(0.0))) for n in zero]
    specs += [(n, [n], bounded(F.col(n).cast("double"), 0.0, 1.0)) for n in ("wp", "vegas_wp")]
    specs += [(n, [n], F.col(n).cast("double")) for n in ("defenders_in_box", "number_of_pass_rushers")]
    specs += [(n, [n], F.col(n).cast("string")) for n in ("defense_man_zone_type", "defense_coverage_type")]
    return derive(df, specs)


def with_situation(df: DataFrame) -> DataFrame:
    """``situ_*`` flags. An unknown input leaves its flag at 0.

    After :func:`coerce_numbers` an unknown clock reads 0, which counts as inside the last minutes.
    """
    diff, togo = or0("score_differential"), or0("ydstogo")
    line = F.coalesce(F.col("yardline_100").cast("double"), F.lit(100.0))
    two_minute = F.coalesce(F.col("half_seconds_remaining"), F.lit(9999.0)) <= 120
    late = F.coalesce(F.col("game_seconds_remaining"), F.lit(9999.0)) <= 240
    coverage = F.lower(F.trim(F.col("defense_man_zone_type")))
    hurry = is_one("no_huddle") if "no_huddle" in df.columns else F.lit(False)
    if "half_seconds_remaining" in df.columns:
        hurry = hurry | two_minute
    rules = [
        ("situ_two_minute", ["half_seconds_remaining"], two_minute),
        ("situ_final_four_minutes", ["game_seconds_remaining"], late),
        ("situ_hurry_up", [], hurry),
        ("situ_red_zone", ["yardline_100"], line <= 20),
        ("situ_goal_line", ["yardline_100", "goal_to_go"], (line <= 5) | is_one("goal_to_go")),
        ("situ_third_down", ["down"], F.col("down") == 3),
        ("situ_fourth_down", ["down"], F.col("down") == 4),
        ("situ_short_yardage", ["ydstogo"], togo <= 2),
        ("situ_long_yardage", ["ydstogo"], togo >= 10),
        ("situ_leading", ["score_differential"], diff > 0),
        ("situ_trailing", ["score_differential"], diff < 0),
        ("situ_trailing_one_score", ["score_differential"], (diff >= -8) & (diff < 0)),
        ("situ_leading_one_score", ["score_differential"], (diff <= 8) & (diff > 0)),
        ("situ_tied", ["score_differential"], diff == 0),
        ("situ_pass_expected", ["xpass"], F.col("xpass") >= 0.60),
        ("situ_run_expected", ["xpass"], F.col("xpass") <= 0.40),
        ("situ_light_box", ["defenders_in_box"], F.col("defenders_in_box") <= 6),
        ("situ_heavy_box", ["defenders_in_box"], F.col("defenders_in_box") >= 8),
        ("situ_man_coverage", ["defense_man_zone_type"], coverage == "man"),
        ("situ_zone_coverage", ["defense_man_zone_type"], coverage == "zone"),
        ("situ_blitz", ["number_of_pass_rushers"], F.col("number_of_pass_rushers") >= 5),
        ("situ_pressure", ["was_pressure"], is_one("was_pressure")),
    ]
    specs = [(name, needs, flag(condition)) for name, needs, condition in rules]
    specs.append(("situ_score_diff_abs", ["score_differential"], F.abs(diff)))
    return derive(df, specs)


def only_season_type(df: DataFrame, kind: str = "REG", column: str = "season_type") -> DataFrame:
    """Rows of one season type; a frame without the column is taken to hold only such rows."""
    return df.where(F.upper(F.trim(column)) == kind) if column in df.columns else df


def active_rows(df: DataFrame, usage: Sequence[str]) -> DataFrame:
    """Rows with any non-zero usage."""
    present = [c for c in usage if c in df.columns]
    total = sum((F.abs(or0(c)) for c in present), F.lit(0.0))
    return df.where(total > 0) if present else df
