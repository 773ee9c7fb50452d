"""Forecast features, context flags and cleaning of observed weather."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.asof import asof_join, asof_nearest
from ..operators.keys import seconds_between
from ..operators.prior import prior_rows
from .cutoff import hours_before
from .derive import flag, or0

# Forecast field -> feature column.
RENAMES = {
    "forecast_lead_hours": "weather_forecast_lead_hours", "temp_f": "weather_temp_air_f",
    "feels_like_f": "weather_feels_like_f", "dew_point_f": "weather_dew_point_f",
    "humidity_pct": "weather_humidity_pct", "pressure_mb": "weather_pressure_mb",
    "wind_speed_mph": "weather_wind_mph", "wind_gust_mph": "weather_wind_gust_mph",
    "precip_probability_pct": "weather_precip_probability_pct", "precip_amount_in": "weather_precip_amount_in",
    "snow_amount_in": "weather_snow_amount_in", "cloud_cover_pct": "weather_cloud_cover_pct",
    "visibility_miles": "weather_visibility_miles", "conditions": "weather_conditions",
    "precip_type": "weather_precip_type", "forecast_generated_ts": "weather_forecast_generated_ts",
    "forecast_valid_ts": "weather_forecast_valid_ts", "forecast_is_backfill": "weather_forecast_is_backfill",
    "forecast_is_historical": "weather_forecast_is_historical", "forecast_source_detail": "weather_forecast_source_detail",
}
# Forecast uncertainty by lead hour, and its default.
TEMP_UNCERTAINTY = {96: 7.5, 72: 6.0, 48: 4.5, 36: 4.0, 24: 3.0, 12: 2.2, 6: 1.5, 3: 1.2, 2: 1.0, 1: 0.8}
WIND_UNCERTAINTY = {96: 9.0, 72: 8.0, 48: 6.0, 24: 4.5, 12: 3.0, 6: 2.0, 3: 1.5, 2: 1.2, 1: 1.0}
TEMP_DEFAULT, WIND_DEFAULT = 4.5, 3.5
# Cloud cover by condition keyword; the last keyword found wins.
CLOUD_BY_CONDITION = (
    ("clear", 0), ("sunny", 0), ("fair", 10), ("partly cloudy", 25), ("mostly cloudy", 75), ("overcast", 100),
    ("cloudy", 50), ("rain", 80), ("drizzle", 60), ("showers", 70), ("thunderstorm", 90), ("snow", 85), ("fog", 95),
)
INDOOR = "DOME|INDOOR|RETRACTABLE|CLOSED"
BAD_WEATHER = "rain|snow|thunderstorm|drizzle|showers"
ROOF_CLOSED_TEAMS = ("ARI", "ATL", "DAL", "DET", "HOU", "IND", "LAR", "LVR", "MIN", "NO")
RETRACTABLE_TEAMS = ("HOU", "MIA", "MIL", "SEA", "TEX", "TOR")


def by_lead_hour(lead: Column, table: dict[int, float], default: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hour = F.bround(lead.cast("double"), 0).cast("int")
    return F.when(lead.isNotNull(), F.coalesce(F.element_at(F.create_map(*pairs), hour), F.lit(default)))


def with_forecast_steps(forecasts: DataFrame, key: str = "game_id", order: str = "forecast_generated_ts", plan="auto") -> DataFrame:
    """Previous snapshot's values, for trends."""
    fields = ("temp_f", "wind_speed_mph", "precip_probability_pct")

    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"prev_{c}": F.lag(c).over(w) for c in fields}

    return prior_rows(forecasts, key, order, 1, build, plan=plan)


def with_forecast_features(df: DataFrame) -> DataFrame:
    """Rename forecast fields and derive trends, uncertainty and hazard flags."""
    have = set(df.columns)
    out = df.withColumns({new: F.col(old) for old, new in RENAMES.items() if old in have})
    lead = F.col("weather_forecast_lead_hours")
    gust = or0("weather_wind_gust_mph") if "wind_gust_mph" in have else F.lit(0.0)
    amount = or0("weather_precip_amount_in") if "precip_amount_in" in have else F.lit(0.0)
    snow = or0("weather_snow_amount_in") if "snow_amount_in" in have else F.lit(0.0)
    columns = {
        "weather_temp_trend": F.col("weather_temp_air_f") - F.col("prev_temp_f"),
        "weather_wind_trend": F.col("weather_wind_mph") - F.col("prev_wind_speed_mph"),
        "weather_precip_prob_trend": F.col("weather_precip_probability_pct") - F.col("prev_precip_probability_pct"),
        "weather_forecast_uncertainty_temp": by_lead_hour(lead, TEMP_UNCERTAINTY, TEMP_DEFAULT),
        "weather_forecast_uncertainty_wind": by_lead_hour(lead, WIND_UNCERTAINTY, WIND_DEFAULT),
        "weather_extreme_wind_flag": flag(F.greatest(or0("weather_wind_mph"), gust) >= 20.0),
        "weather_freezing_flag": flag(or0("weather_temp_air_f", 60.0) <= 32.0),
        "weather_heavy_precip_flag": flag((or0("weather_precip_probability_pct") >= 70.0) | (amount >= 0.25) | (snow >= 0.5)),
    }
    for name in ("weather_forecast_is_backfill", "weather_forecast_is_historical"):
        if name in out.columns:
            columns[name] = F.coalesce(F.col(name).cast("int"), F.lit(0))
    drops = [c for c in (*RENAMES, "prev_temp_f", "prev_wind_speed_mph", "prev_precip_probability_pct") if c in have]
    return out.withColumns(columns).drop(*drops)


def attach_forecast(df: DataFrame, forecasts: DataFrame, cutoff: str = "decision_cutoff_ts", key: str = "game_id") -> DataFrame:
    """Latest forecast generated at or before the cutoff, with derived features."""
    stepped = with_forecast_steps(forecasts, key)
    fields = [c for c in stepped.columns if c not in (key, "forecast_generated_ts") and c not in df.columns]
    joined = asof_join(df, stepped, key, cutoff, "forecast_generated_ts", fields, matched_ts="forecast_generated_ts")
    return with_forecast_features(joined)


def with_context_flags(df: DataFrame, roof: str = "roof") -> DataFrame:
    """Indoor flag and a bad-passing flag that indoor venues suppress."""
    needed = ("weather_wind_mph", "weather_wind_gust_mph", "weather_precip_probability_pct", "weather_precip_amount_in", "weather_snow_amount_in")
    flags = ("weather_extreme_wind_flag", "weather_heavy_precip_flag", "weather_freezing_flag")
    missing = {c: F.lit(None).cast("double") for c in needed if c not in df.columns}
    missing |= {c: F.lit(None).cast("int") for c in flags if c not in df.columns}
    if roof not in df.columns:
        missing[roof] = F.lit(None).cast("string")
    out = df.withColumns(missing) if missing else df
    indoor = F.coalesce(F.upper(F.col(roof)).rlike(INDOOR), F.lit(False))
    windy = F.greatest(or0("weather_wind_mph"), or0("weather_wind_gust_mph") * 0.8) >= 17.0
    wet = (or0("weather_precip_probability_pct") >= 60.0) | (or0("weather_precip_amount_in") >= 0.25) | (or0("weather_snow_amount_in") >= 0.25)
    severe = reduce(lambda a, b: a | b, [or0(c, 0) == 1 for c in flags], windy | wet)
    return out.withColumns({"roof_is_indoor_flag": flag(indoor), "weather_bad_passing_flag": flag(severe & ~indoor)})


def clean_observed(df: DataFrame) -> DataFrame:
    """Fill precipitation, wind direction and cloud cover of observed weather."""
    have = set(df.columns)
    closed = F.coalesce(F.col("is_roof_closed"), F.lit(0)) if "is_roof_closed" in have else F.lit(0)
    columns = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("precip", "precipprob") if c in have}
    speed = F.col("windspeed") if "windspeed" in have else F.lit(None).cast("double")
    if "winddir" in have:
        direction = F.col("winddir")
        if "wind_bearing" in have:
            direction = F.coalesce(direction, F.col("wind_bearing"))
        still = speed.isNull() | (speed == 0)
        columns["winddir"] = F.when(direction.isNull() & still, 0.0).otherwise(direction)
        if "windspeed" in have:
            columns["windspeed"] = F.when(direction.isNull() & speed.isNull(), 0.0).otherwise(speed)
    if "cloudcover" in have:
        # The wind step runs first, so a row without any wind reading already counts as calm.
        calm = columns.get("windspeed", speed) == 0
        guess = F.lit(50.0)
        if "conditions" in have:
            text = F.lower(F.coalesce(F.col("conditions"), F.lit("")))
            for word, value in CLOUD_BY_CONDITION:
                guess = F.when((closed == 0) & text.contains(word), float(value)).otherwise(guess)
        columns["cloudcover"] = F.when(F.col("cloudcover").isNotNull(), F.col("cloudcover")).when((closed == 1) | calm, 0.0).otherwise(guess)
    return df.withColumns(columns)


def with_roof_status(df: DataFrame, team: str = "home_team_abbr") -> DataFrame:
    """Closed roofs by team; retractable ones also in bad weather."""
    closed = F.coalesce(F.col(team).isin(*ROOF_CLOSED_TEAMS), F.lit(False))
    if "conditions" in df.columns:
        bad = F.lower(F.coalesce(F.col("conditions"), F.lit(""))).rlike(BAD_WEATHER)
        closed = closed | (F.col(team).isin(*RETRACTABLE_TEAMS) & bad)
    return df.withColumn("is_roof_closed", flag(closed))


def with_wind_features(df: DataFrame) -> DataFrame:
    """Circular direction (0 in calm or unknown wind), components, resistance, assistance.

    NaN readings count as missing.
    """
    direction = F.when(~F.isnan("winddir"), F.col("winddir"))
    speed = F.when(~F.isnan("windspeed"), F.col("windspeed"))
    angle = F.radians(direction)
    windy = (speed > 0) & direction.isNotNull()
    along, across = speed * F.cos(angle), speed * F.sin(angle)
    return df.withColumns(
        {
            "wind_sin": F.when(windy, F.sin(angle)).otherwise(0.0),
            "wind_cos": F.when(windy, F.cos(angle)).otherwise(0.0),
            "wind_x": along,
            "wind_y": across,
            "headwind_component": along,
            "crosswind_component": across,
            "wind_resistance": speed * speed * 0.001,
            "wind_assistance": -along,
        }
    )


def attach_observed(
    df: DataFrame,
    hourly: DataFrame,
    keys: list[str],
    ts: str,
    hourly_ts: str,
    columns: list[str],
    tolerance_seconds: float = 3600.0,
    indoor: Column | None = None,
) -> DataFrame:
    """Hourly weather nearest to the event, backward first; indoors the wind is calm.

    ``weather_matched`` says whether a reading was found within the tolerance.
    """
    stamped = df.withColumn("_hour", F.date_trunc("hour", F.col(ts)).cast(df.schema[ts].dataType))
    out = asof_nearest(stamped, hourly, keys, "_hour", hourly_ts, columns, tolerance_seconds, "backward_first", matched_ts="_matched")
    out = out.withColumn("weather_matched", flag(F.col("_matched").isNotNull())).drop("_hour", "_matched")
    if indoor is not None:
        calm = {c: F.when(indoor, 0.0).otherwise(F.col(c)) for c in columns if c.startswith(("windspeed", "windgust"))}
        out = out.withColumns(calm) if calm else out
    return out


def modal_interval_seconds(df: DataFrame, keys: list[str], ts: str) -> float | None:
    """Most frequent gap between samples; the usual tolerance of a weather match."""
    gaps = prior_rows(df, keys, ts, 1, lambda w: {"_gap": seconds_between(F.col(ts), F.lag(ts).over(w))})
    top = gaps.where("_gap > 0").groupBy("_gap").count().orderBy(F.desc("count"), "_gap").limit(1).collect()
    return float(top[0]["_gap"]) if top else None


def forecast_schedule(games: DataFrame, leads: list[float], now: Column, start: str = "start_time_utc", ingested: Column | None = None) -> DataFrame:
    """One row per game and lead hour.

    Snapshots more than a minute in the future are left out; one generated over 30 minutes before
    it was ingested is a backfill.
    """
    rows = games.withColumn("forecast_lead_hours", F.explode(F.array(*[F.lit(float(h)) for h in leads])))
    generated = hours_before(F.col(start), F.col("forecast_lead_hours"))
    rows = rows.withColumns({"forecast_generated_ts": generated, "forecast_valid_ts": F.col(start)})
    rows = rows.where(F.col("forecast_generated_ts") <= now + F.expr("INTERVAL 1 MINUTE"))
    taken = ingested if ingested is not None else now
    historical = F.col(start) < now
    return rows.withColumns(
        {
            "forecast_is_backfill": flag(F.col("forecast_generated_ts") < taken - F.expr("INTERVAL 30 MINUTES")),
            "forecast_is_historical": flag(historical),
            "forecast_source_detail": F.when(historical, "historical_backfill").otherwise("live_pull"),
        }
    )


def to_imperial(df: DataFrame) -> DataFrame:
    """Celsius to Fahrenheit and km/h to mph; NULL stays NULL."""
    columns = {c: F.col(c) * 9 / 5 + 32 for c in ("temp", "feelslike") if c in df.columns}
    columns |= {c: F.col(c) * 0.621371 for c in ("windspeed", "windgust") if c in df.columns}
    return df.withColumns(columns) if columns else df
