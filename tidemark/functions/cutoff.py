"""Decision cutoffs: what was known when."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CutoffPolicy:
    """Hours between the decision and the start of an event.

    ``by_season_type`` overrides the default per season type; ``fallback`` counts back from the
    start of the event's date where no start time is known.
    """

    # Default lead times in hours.
    default: float = 6.0
    fallback: float = 36.0
    by_season_type: Mapping[str, float] | None = None
    horizons: tuple[float, ...] = (6.0,)
    drop_missing_snapshots: bool = True


_ACTIVE: ContextVar[CutoffPolicy] = ContextVar("cutoff_policy", default=CutoffPolicy())


def active_policy() -> CutoffPolicy:
    return _ACTIVE.get()


@contextmanager
def cutoff_policy(policy: CutoffPolicy):
    """Use ``policy`` inside the block, e.g. once per horizon."""
    token = _ACTIVE.set(policy)
    try:
        yield policy
    finally:
        _ACTIVE.reset(token)


def policy_from_config(config: Mapping) -> CutoffPolicy:
    """Read the ``decision_cutoff`` section of a job configuration."""
    base = CutoffPolicy()
    hours = float(config.get("hours_before_kickoff", base.default))
    horizons = tuple(sorted({round(float(h), 4) for h in config.get("horizons_hours") or ()})) or (hours,)
    keep = config.get("drop_missing_snapshots", True)
    if isinstance(keep, str):
        keep = keep.strip().lower() in {"1", "true", "yes", "y", "on"}
    return CutoffPolicy(
        default=hours,
        fallback=float(config.get("fallback_hours_before_kickoff", base.fallback)),
        by_season_type=config.get("season_type_overrides") or None,
        horizons=horizons,
        drop_missing_snapshots=bool(keep),
    )


def hours_before(ts: Column, hours: Column | float) -> Column:
    """``ts`` minus a number of hours (fractions allowed)."""
    micros = (F.lit(hours) if isinstance(hours, (int, float)) else hours) * F.lit(3600.0)
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))


def cutoff_hours(policy: CutoffPolicy, season_type: str | None = None) -> Column:
    """Lead time as a column: the season type's own value or the default."""
    if not season_type or not policy.by_season_type:
        return F.lit(float(policy.default))
    branch = None
    for label, hours in policy.by_season_type.items():
        condition = F.upper(F.col(season_type)) == label.upper()
        branch = F.when(condition, F.lit(float(hours))) if branch is None else branch.when(condition, F.lit(float(hours)))
    return branch.otherwise(F.lit(float(policy.default)))


def with_cutoff(
    df: DataFrame,
    start: str,
    hours: float | None = None,
    out: str = "decision_cutoff_ts",
    date: str | None = None,
    season_type: str | None = None,
    policy: CutoffPolicy | None = None,
) -> DataFrame:
    """Add the decision time: start minus the lead, or date minus the fallback lead."""
    policy = policy or active_policy()
    lead = F.lit(float(hours)) if hours is not None else cutoff_hours(policy, season_type)
    value = hours_before(F.col(start), lead)
    if date:
        value = F.coalesce(value, hours_before(F.col(date).cast(df.schema[start].dataType), policy.fallback))
    return df.withColumn(out, value)


def cutoff_label(hours: float) -> str:
    """``h06h`` for whole hours, ``h090m`` otherwise."""
    minutes = round(hours * 60)
    return f"h{minutes:03d}m" if minutes % 60 else f"h{minutes // 60:02d}h"


def cutoff_label_column(hours: Column) -> Column:
    minutes = F.round(hours * 60).cast("int")
    whole = F.format_string("h%02dh", (minutes / 60).cast("int"))
    return F.when(minutes % 60 == 0, whole).otherwise(F.format_string("h%03dm", minutes))


def with_horizons(df: DataFrame, horizons: Sequence[float], out: str = "decision_horizon_hours") -> DataFrame:
    """One row per horizon; the list is a fixed literal, so rows grow by its length only."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(float(h)) for h in horizons])))


def known_flags(df: DataFrame, snapshots: Sequence[str], cutoff: str) -> DataFrame:
    """``<ts>_missing`` and ``<ts>_known_at_cutoff`` as 0/1 per snapshot column."""
    columns = {}
    for ts in snapshots:
        columns[f"{ts}_missing"] = F.when(F.col(ts).isNull(), 1).otherwise(0)
        columns[f"{ts}_known_at_cutoff"] = F.when(F.col(ts) <= F.col(cutoff), 1).otherwise(0)
    return df.withColumns(columns)


def drop_missing(df: DataFrame, snapshots: Sequence[str], enabled: bool | None = None) -> DataFrame:
    """Drop rows lacking any required snapshot; the policy's switch decides by default."""
    enabled = active_policy().drop_missing_snapshots if enabled is None else enabled
    return df.na.drop(subset=list(snapshots)) if enabled else df


def split_violations(df: DataFrame, snapshots: Sequence[str], cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, violations): a violation has any snapshot later than its cutoff.

    Violations carry the names of the late feeds, ready for an audit sink.
    """
    late = F.array_compact(F.array(*[F.when(F.col(s) > F.col(cutoff), F.lit(s)) for s in snapshots]))
    tagged = df.withColumn("late_feeds", late)
    return tagged.where(F.size("late_feeds") == 0).drop("late_feeds"), tagged.where(F.size("late_feeds") > 0)


def guard_snapshots(df: DataFrame, snapshots: Sequence[str], cutoff: str, audit_path: str | None = None) -> DataFrame:
    """Filter violations, writing them to ``audit_path`` first when given."""
    clean, violations = split_violations(df, snapshots, cutoff)
    if audit_path:
        violations.write.mode("append").parquet(audit_path)
    return clean
