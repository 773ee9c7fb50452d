"""Availability: report summaries known at the cutoff, heuristics, priors, eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grains import prior_event_rate
from ..operators.keys import clip, join_on, latest_by, nz, seconds_between
from .derive import derive, flag, lookup

# Inactive probability by status, and the defaults.
REPORT_PROB = {"OUT": 0.98, "DOUBTFUL": 0.85, "QUESTIONABLE": 0.55, "SUSPENDED": 0.9}
PRACTICE_PROB = {"DID NOT PARTICIPATE": 0.8, "LIMITED": 0.5, "FULL": 0.1}
REPORT_DEFAULT, PRACTICE_DEFAULT, UNKNOWN_PROB = 0.1, 0.15, 0.1
PRACTICE_KINDS = (("dnp", "DID NOT PARTICIPATE"), ("limited", "LIMITED"), ("full", "FULL"))
INACTIVE_DESIGNATIONS = ("OUT", "DOUBTFUL", "INACTIVE")
FALLBACK_WIDTH = 0.65
# Statuses that exclude a player from scoring.
EXCLUDED_ROSTER = (
    "IR", "IR-R", "IR-N", "IR-C", "PUP", "NFI", "DNR", "SUS", "EXEMPT", "RET", "COVID", "PS", "WAV", "CUT", "RES",
    "RESERVE", "RES-RET", "DEV",
)
EXCLUDED_GAME = ("OUT", "DOUBTFUL", "INACTIVE", "SUSPENDED")
SCORED_POSITIONS = ("QB", "RB", "WR", "TE")


def inactive_probability(report: Column, practice: Column, dnp_count: Column | None = None) -> Column:
    """Larger of the two status probabilities; repeated missed practice adds 0.1, capped at 1."""
    base = F.greatest(lookup(report, REPORT_PROB, REPORT_DEFAULT), lookup(practice, PRACTICE_PROB, PRACTICE_DEFAULT))
    if dnp_count is not None:
        base = F.when(nz(dnp_count) >= 2, F.least(base + 0.1, F.lit(1.0))).otherwise(base)
    return F.coalesce(base, F.lit(UNKNOWN_PROB))


def _says(text: str, status: Column) -> Column:
    return status.contains(text)


def report_summary(
    reports: DataFrame,
    keys: Sequence[str] = ("season", "week", "player_id"),
    reported: str = "reported_at",
    cutoff: str = "decision_cutoff_ts",
    start: str | None = "game_start_utc",
    report: str = "report_status",
    practice: str = "practice_status",
) -> DataFrame:
    """One row per player-week from the reports known at the cutoff: one scan, one shuffle.

    The status sequences are texts of the output row, so the reports of a key are gathered in one
    ordered aggregate; everything else of the row is read off its ends.
    """
    keys = list(keys)
    known = reports.where(F.col(reported).isNotNull() & (F.col(reported) <= F.col(cutoff)))
    status, practised = F.upper(F.trim(report)), F.upper(F.trim(practice))
    entry = F.struct(F.col(reported).alias("at"), F.when(F.length(practised) > 0, practised).alias("practice"), F.when(F.length(status) > 0, status).alias("report"))
    counts = {"injury_report_count": F.count(F.lit(1)), "_cutoff": F.max(cutoff), "_reports": F.array_sort(F.collect_list(entry))}
    if start:
        counts["_start"] = F.max(start)
    for name, text in PRACTICE_KINDS:
        counts[f"injury_practice_{name}_count"] = F.sum(flag(practised.contains(text)))
    out = known.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    stated = lambda f: F.filter(F.transform("_reports", lambda e: e[f]), lambda e: e.isNotNull())
    out = out.withColumns({"_practices": stated("practice"), "_statuses": stated("report")})
    size = F.size("_practices")
    last3 = F.slice("_practices", F.greatest(size - 2, F.lit(1)), F.lit(3))
    columns = {f"injury_practice_status_day{i}": F.get("_practices", F.lit(i - 1)) for i in (1, 2, 3)}
    columns |= {
        "injury_practice_status_sequence": F.when(size > 0, F.array_join("_practices", ">")),
        "injury_report_status_sequence": F.when(F.size("_statuses") > 0, F.array_join("_statuses", ">")),
        "injury_game_designation": F.try_element_at("_statuses", F.lit(-1)),
        "injury_practice_status": F.try_element_at("_practices", F.lit(-1)),
        "injury_is_listed": F.lit(1),
    }
    for name, text in PRACTICE_KINDS:
        columns[f"injury_practice_{name}_last3"] = F.size(F.filter(last3, partial(_says, text)))
    out = out.withColumns(columns)
    last, before = F.try_element_at("_reports", F.lit(-1))["at"], F.try_element_at("_reports", F.lit(-2))["at"]
    whole_hours = lambda a, b: F.floor(seconds_between(a, b) / 60) / 60
    times = {
        "injury_hours_since_last_report": whole_hours(F.col("_cutoff"), last),
        "injury_hours_between_last_reports": whole_hours(last, before),
        "injury_is_inactive_designation": flag(F.col("injury_game_designation").isin(*INACTIVE_DESIGNATIONS)),
        "injury_inactive_probability": inactive_probability(
            F.col("injury_game_designation"), F.col("injury_practice_status"), F.col("injury_practice_dnp_count")
        ),
    }
    if start:
        times["injury_hours_until_game_at_last_report"] = whole_hours(F.col("_start"), last)
    return out.withColumns(times).drop("_cutoff", "_start", "_practices", "_statuses", "_reports")


def unavailable(df: DataFrame) -> Column:
    """Ruled out by designation or report; the roster status alone never counts."""
    rules = (("injury_game_designation", INACTIVE_DESIGNATIONS), ("injury_report_status", ("OUT", "DOUBTFUL")))
    hits = [F.coalesce(F.upper(F.col(c)).isin(*values), F.lit(False)) for c, values in rules if c in df.columns]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def eligible(df: DataFrame) -> Column:
    """Players that can be scored: a scored position and no excluding status or designation."""
    have = set(df.columns)
    ok = F.upper(nz("position", "")).isin(*SCORED_POSITIONS) if "position" in have else F.lit(True)
    if "status" in have:
        status = F.upper(F.trim(nz("status", "")))
        ok = ok & ~(status.isin(*EXCLUDED_ROSTER) | status.startswith("IR") | status.startswith("RESERVE"))
    named = [c for c in ("injury_game_status", "injury_game_designation") if c in have]
    if named:
        blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.upper(F.trim(c)))
        text = F.coalesce(*[blank(F.col(c)) for c in named], F.lit(""))
        ok = ok & ~text.rlike("|".join(EXCLUDED_GAME))
    return ok


def with_model_fallback(df: DataFrame, prefix: str = "injury_inactive_probability") -> DataFrame:
    """Model probability, or the heuristic where the model's interval is too wide."""
    wide = F.col(f"{prefix}_interval_width") > FALLBACK_WIDTH
    heuristic, model = F.col(prefix), F.col(f"{prefix}_model")
    chosen = F.when(wide, heuristic).otherwise(model)
    specs = [
        (f"{prefix}_source", [], F.when(wide, "heuristic").otherwise("model")),
        (prefix, [], chosen),
        (f"{prefix}_low", [f"{prefix}_low"], F.when(wide, heuristic).otherwise(F.col(f"{prefix}_low"))),
        (f"{prefix}_high", [f"{prefix}_high"], F.when(wide, heuristic).otherwise(F.col(f"{prefix}_high"))),
    ]
    return derive(df, specs)


def with_availability(df: DataFrame, model: str = "injury_inactive_probability_model") -> DataFrame:
    p = clip(nz(model, 0.0), 0.0, 1.0)
    return df.withColumns({"availability_inactive_prob": p, "availability_uncertainty": p * (1 - p)})


def with_prior_rates(df: DataFrame, order: str, event: str = "injury_is_inactive_designation") -> DataFrame:
    """Inactive rate in earlier weeks of the player, of the depth slot and of the practice pattern."""
    slot = F.concat_ws("|", nz("team", "UNKNOWN"), nz("depth_chart_position", "UNKNOWN"))
    keyed = df.withColumns({"_slot": slot, "_pattern": nz("injury_practice_status_sequence", "UNKNOWN")})
    for key, out in (("player_id", "player"), ("_slot", "depth_slot"), ("_pattern", "practice_pattern")):
        keyed = prior_event_rate(keyed, [key], order, event, f"injury_{out}_inactive_rate_prior")
    return keyed.drop("_slot", "_pattern")


def known_snapshot_values(df: DataFrame, snapshots: DataFrame, keys: Sequence[str], ts: str, cutoff: str, columns: Sequence[str]) -> DataFrame:
    """Values of the latest snapshot per key if known at the cutoff, NULL otherwise."""
    newest = latest_by(snapshots, list(keys), [F.col(ts)], [ts, *columns])
    fresh = newest.select(*keys, F.col(ts), *[F.col(c).alias(f"__s_{c}") for c in columns])
    joined = join_on(df.drop(*[c for c in columns if c in df.columns]), fresh, list(keys))
    return joined.withColumns({c: F.when(F.col(ts) <= F.col(cutoff), F.col(f"__s_{c}")) for c in columns}).drop(*[f"__s_{c}" for c in columns])


def with_history_fallback(df: DataFrame, history: DataFrame, entity: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Feature of the same week if stored, else the entity's latest stored value."""
    same = history.select(*keys, *[F.col(c).alias(f"__w_{c}") for c in columns])
    last = latest_by(history, entity, [F.col(o) for o in order], columns).select(entity, *[F.col(c).alias(f"__l_{c}") for c in columns])
    out = join_on(join_on(df, same, list(keys)), last, entity, prefix="__k_")
    return out.withColumns({c: F.coalesce(f"__w_{c}", f"__l_{c}") for c in columns}).drop(
        *[f"__w_{c}" for c in columns], *[f"__l_{c}" for c in columns]
    )
