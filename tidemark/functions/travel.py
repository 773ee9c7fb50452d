"""Places and time: distances, local times, event clocks, sequence annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.keys import as_list, seconds_between
from ..operators.prior import prefix_sums, prior_rows, runs
from .derive import bounded, flag

# Radius of the earth and the mile.
EARTH_RADIUS_KM = 6371.0
MILES_PER_KM = 0.621371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def tz_offset_hours(zone: Column, instant: Column) -> Column:
    """Hours a zone is ahead of UTC at an instant (session time zone UTC)."""
    moment = instant.cast("timestamp")
    return seconds_between(F.from_utc_timestamp(moment, zone), moment) / 3600


def local_hour(zone: Column, instant: Column) -> Column:
    local = F.from_utc_timestamp(instant.cast("timestamp"), zone)
    return F.hour(local) + F.minute(local) / 60


def eastern_to_utc(day: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """Local date and time text to UTC.

    A skipped local time moves forward over the gap; a repeated one is ambiguous and NULL.
    """
    local = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock))
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    repeats = (F.from_utc_timestamp(utc - hour, zone) == local) | (F.from_utc_timestamp(utc + hour, zone) == local)
    return F.when(~repeats, utc)


def event_clock(start: Column, period: Column, remaining: Column, date: Column | None = None) -> Column:
    """Time of an event from the start and the game clock: quarters of 900 s, overtime of 600 s.

    Without a start the date at 17:00 stands in; without a clock the start is returned.
    """
    begin = F.coalesce(start, date.cast("timestamp") + F.expr("INTERVAL 17 HOURS")) if date is not None else start
    regular = (period - 1) * 900 + (900 - bounded(remaining, 0, 900))
    overtime = 3600 + (period - 5) * 600 + (600 - bounded(remaining, 0, 600))
    elapsed = F.when(period.between(1, 4), regular).when(period >= 5, overtime)
    moved = begin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), elapsed.cast("decimal(18,6)"))
    return F.coalesce(moved, begin)


def team_rows(schedule: DataFrame, home: str = "home_team", away: str = "away_team", keep: Sequence[str] | None = None) -> DataFrame:
    """Two rows per game: each team with its opponent. One explode, no self union."""
    have = set(schedule.columns)
    score = {"home_score", "away_score"} <= have

    def side(mine: str, other: str, is_home: int) -> Column:
        fields = [F.col(mine).alias("team"), F.col(other).alias("opponent"), F.lit(is_home).alias("is_home")]
        if score:
            fields += [F.col(f"{'home' if is_home else 'away'}_score").alias("team_score"), F.col(f"{'away' if is_home else 'home'}_score").alias("opponent_score")]
        return F.struct(*fields)

    kept = list(keep) if keep is not None else schedule.columns
    return schedule.select(*kept, F.explode(F.array(side(home, away, 1), side(away, home, 0))).alias("_s")).select(*kept, "_s.*")


def with_sequence(df: DataFrame, team: str = "team", start: str = "start_time_utc", plan="auto") -> DataFrame:
    """Running number, rest, travel, time-zone change, home and road runs, calendar flags.

    ``plan=None`` says that groups are bounded, as by one row per game of a team.
    """
    base = df.withColumns(
        {
            "game_timezone_offset": tz_offset_hours(F.col("stadium_tz"), F.col(start)),
            "team_timezone_offset": tz_offset_hours(F.col("team_home_tz"), F.col(start)),
            "local_start_hour": local_hour(F.col("stadium_tz"), F.col(start)),
        }
    )

    def step(w: WindowSpec) -> dict[str, Column]:
        return {
            "rest_days": seconds_between(F.col(start), F.lag(start).over(w)) / 86400,
            "travel_km": haversine_km(F.lag("stadium_lat").over(w), F.lag("stadium_lon").over(w), F.col("stadium_lat"), F.col("stadium_lon")),
            "timezone_change_hours": F.col("game_timezone_offset") - F.lag("game_timezone_offset").over(w),
        }

    out = prior_rows(base, team, start, 1, step, plan=plan)
    out = prior_rows(
        out, team, start, 2,
        lambda w: {f"{c}_rolling3": F.avg(c).over(w.rowsBetween(-2, 0)) for c in ("travel_km", "rest_days")}, plan=plan,
    )
    out = prefix_sums(out, team, start, {"_played": F.lit(1)}, plan=plan)
    out = runs(out, team, start, "is_home", "_run")
    away_by = F.col("game_timezone_offset") - F.col("team_timezone_offset")
    return out.withColumns(
        {
            "season_game_number": (F.col("_played") + 1).cast("int"),
            "rest_hours": F.col("rest_days") * 24,
            "travel_miles": F.col("travel_km") * MILES_PER_KM,
            "time_diff_from_home_hours": away_by,
            "consecutive_home_games": F.when(F.col("is_home") == 1, F.col("_run")).otherwise(0),
            "consecutive_road_games": F.when(F.col("is_home") == 1, 0).otherwise(F.col("_run")),
            "is_short_week": flag(F.col("rest_days") <= 5),
            "is_long_rest": flag(F.col("rest_days") >= 10),
            "bye_week_flag": flag(F.col("rest_days") >= 13),
            "west_to_east_early": flag((away_by < -1.5) & (F.col("local_start_hour") < 13)),
            "east_to_west_late": flag((away_by > 1.5) & (F.col("local_start_hour") > 19)),
        }
    ).drop("_played", "_run")


def with_gap_features(df: DataFrame, entity: str, order: str | Sequence[str], ts: str, depth: str | None = "depth_chart_order", plan="auto") -> DataFrame:
    """Minutes, hours and days since the previous event, and the change of an order column."""

    def build(w: WindowSpec) -> dict[str, Column]:
        minutes = F.floor(seconds_between(F.col(ts), F.lag(ts).over(w)) / 60)
        out = {"minutes_since_last": minutes, "hours_since_last": minutes / 60, "rest_days_since_last": minutes / 1440}
        if depth:
            out["depth_order_delta"] = F.col(depth).cast("double") - F.lag(depth).over(w)
        return out

    return prior_rows(df, entity, as_list(order), 1, build, plan=plan)


def with_changes(df: DataFrame, entity: str, order: Sequence[str], label: str, out: str, plan="auto") -> DataFrame:
    """1 where a known label differs from the previous known one, and whether either of the last two did."""

    def first(w: WindowSpec) -> dict[str, Column]:
        return {f"{out}_last_game": flag(F.col(label) != F.lag(label).over(w))}

    step = prior_rows(df, entity, list(order), 1, first, plan=plan)
    return prior_rows(
        step, entity, list(order), 1,
        lambda w: {f"{out}_last2": F.greatest(F.col(f"{out}_last_game"), F.coalesce(F.lag(f"{out}_last_game").over(w), F.lit(0)))}, plan=plan,
    )


def fill_timestamps(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Missing times: midpoint of the neighbours, 10 ms beyond the only neighbour at the ends.

    Runs of missing rows share one midpoint. Neighbours come from two as-of carries over the row
    order, which hot keys cut into slices.
    """
    from ..operators.asof import asof_join

    keys, order = as_list(keys), list(order)
    numbered = prefix_sums(df, keys, order, {"_pos": F.lit(1)})
    known = numbered.where(F.col(ts).isNotNull()).select(*keys, "_pos", F.col(ts).alias("_known"))
    out = asof_join(numbered, known.withColumnRenamed("_known", "_back").withColumnRenamed("_pos", "_bp"), keys, "_pos", "_bp", ["_back"])
    out = asof_join(out, known.withColumnRenamed("_known", "_ahead").withColumnRenamed("_pos", "_fp"), keys, "_pos", "_fp", ["_ahead"], "forward")
    back, ahead = F.unix_micros(F.col("_back").cast("timestamp")), F.unix_micros(F.col("_ahead").cast("timestamp"))
    micros = F.coalesce(F.floor((back + ahead) / 2), back + 10_000, ahead - 10_000)
    filled = F.timestamp_micros(micros.cast("bigint")).cast(df.schema[ts].dataType)
    return out.withColumn(ts, F.coalesce(F.col(ts), filled)).drop("_pos", "_back", "_ahead")


def with_calendar(df: DataFrame, ts: str, team: str | None = None, home: str | None = None) -> DataFrame:
    """Hour, weekday with Monday as 1, and the home flag."""
    columns = {"game_start_hour_utc": F.hour(ts), "game_day_of_week": F.weekday(ts) + 1}
    if team and home:
        columns["is_home"] = flag(F.col(team) == F.col(home))
    return df.withColumns(columns)
