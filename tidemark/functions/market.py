"""Betting markets: prices to probabilities, consensus across books, snapshots and moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import attach_totals, join_on, latest_by
from ..operators.quantiles import quantiles
from ..operators.slices import group_sizes, spread, tasks_for
from ..session import cut_lineage
from .text import last_name

# Spread of final margins around the line.
MARGIN_SIGMA = 13.45
# Snapshot labels, their column suffixes, and the labels moves are measured against.
SNAPSHOTS = {"cutoff": "", "2h": "_2h", "6h": "_6h", "24h": "_24h", "open": "_open"}
MOVES_FROM = ("open", "24h", "6h", "2h")
MOVING = (
    "moneyline_home", "moneyline_away", "spread_line", "spread_home_price", "spread_away_price", "total_line",
    "total_over_price", "total_under_price", "implied_prob_home", "implied_prob_away", "moneyline_vig",
)
BOOKS = (
    "array<struct<key:string,markets:array<struct<key:string,"
    "outcomes:array<struct<name:string,description:string,price:double,point:double>>>>>>"
)
ODDS_SCHEMA = f"struct<data:struct<bookmakers:{BOOKS}>,bookmakers:{BOOKS}>"


def american_to_prob(price: Column) -> Column:
    """Implied probability of an American price; NULL for 0."""
    return F.when(price > 0, 100.0 / (price + 100.0)).when(price < 0, -price / (-price + 100.0))


def erf(x: Column) -> Column:
    """Error function, Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    # Published coefficients, highest power first.
    coefficients = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), coefficients, F.lit(0.0)) * t
    return F.signum(x) * (1.0 - poly * F.exp(-a * a))


def normal_cdf(x: Column, mean: Column | float = 0.0, sigma: float = 1.0) -> Column:
    return 0.5 * (1.0 + erf((x - mean) / (sigma * 2.0**0.5)))


def spread_to_win_prob(spread: Column) -> Column:
    """Home win probability from the home spread (negative favours home)."""
    return normal_cdf(-spread, 0.0, MARGIN_SIGMA)


def pct_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before))


def explode_outcomes(snapshots: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """JSON snapshots to one row per (snapshot, book, market, outcome).

    The body may or may not sit under ``data``; ``from_json`` needs only the fields we read.
    """
    body = F.from_json(F.col(payload), ODDS_SCHEMA)
    parsed = spread(snapshots, [payload]).select(*keys, body.alias("_j")).select(*keys, F.coalesce("_j.data.bookmakers", "_j.bookmakers").alias("_books"))
    # Outer explodes: an inner one infers a filter that would parse the text a second time.
    books = parsed.select(*keys, F.explode_outer("_books").alias("_b"))
    markets = books.select(*keys, F.col("_b.key").alias("book"), F.explode_outer("_b.markets").alias("_m")).where(F.col("_m.key").isNotNull())
    return markets.select(*keys, "book", F.col("_m.key").alias("market"), F.explode_outer("_m.outcomes").alias("_o")).select(
        *keys, "book", "market", F.col("_o.name").alias("outcome"), F.col("_o.description").alias("description"),
        F.col("_o.price").alias("price"), F.col("_o.point").alias("point"),
    )


# Consensus value -> (market, side, quoted field, both fields needed).
CONSENSUS = {
    "moneyline_home": ("h2h", "home", "price"),
    "moneyline_away": ("h2h", "away", "price"),
    "spread_line": ("spreads", "home", "point"),
    "spread_home_price": ("spreads", "home", "price"),
    "spread_away_price": ("spreads", "away", "price"),
    "total_line": ("totals", None, "point"),
    "total_over_price": ("totals", "over", "price"),
    "total_under_price": ("totals", "under", "price"),
}
BOOK_COUNTS = {"h2h": "moneyline_book_count", "spreads": "spread_book_count", "totals": "total_book_count"}


#: Quotes of one event up to which its medians are taken from lists; beyond it they are ranked in slices.
SMALL_GROUP = 10_000


def consensus(outcomes: DataFrame, keys: Sequence[str], home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Cross-book medians, line deviations (population, two quotes at least), book counts, vig.

    One narrow count finds events with more than ``SMALL_GROUP`` quotes. Where there are none, quotes are laid out by event in tasks of
    a set number of rows and all figures come from one grouping there: exact medians are the middle of a sorted list, and no half-filled
    buffer of an event moves between tasks. Else quotes become long (metric, value) rows whose ranks are cut in slices.
    """
    side = (
        F.when(F.col("outcome") == F.col(home), "home").when(F.col("outcome") == F.col(away), "away")
        .when(F.col("outcome") == "Over", "over").when(F.col("outcome") == "Under", "under")
    )
    priced = F.col("price").isNotNull() & ((F.col("market") == "h2h") | F.col("point").isNotNull())
    # Parsed quotes feed the sizing pass and the figures: parse the JSON once, and write only what both read.
    read = [c for c in ("market", "book", "price", "point") if c not in keys]
    quotes = cut_lineage(outcomes.select(*keys, *read, side.alias("_side")))
    hits = {}
    for name, (market, wanted, field) in CONSENSUS.items():
        hit = (F.col("market") == market) & priced
        hits[name] = (hit & (F.col("_side") == wanted) if wanted else hit, field)
    count, most = group_sizes(quotes, keys)
    if most > SMALL_GROUP:
        out = _ranked_consensus(quotes, keys, hits, priced)
    else:
        # Columns of their own: list aggregates interpret their argument for every row, a projection is compiled.
        values = {n: F.when(hit, F.col(field)) for n, (hit, field) in hits.items()}
        books = {n: F.when(F.col("market") == m, F.col("book")) for m, n in BOOK_COUNTS.items()}
        unnamed = {f"_no_{n}": F.when((F.col("market") == m) & F.col("book").isNull(), 1).otherwise(0) for m, n in BOOK_COUNTS.items()}
        slim = quotes.select(*keys, *[c.alias(n) for n, c in (values | books | unnamed).items()])
        figures = [(F.size(F.collect_set(n)) + F.max(f"_no_{n}")).alias(n) for n in books]
        figures += [F.collect_list(n).alias(n) for n in values]
        figures += [F.when(F.count(n) >= 2, F.stddev_pop(n)).alias(f"{n}_std") for n in ("spread_line", "total_line")]
        laid = slim.repartition(tasks_for(slim, count), *keys)
        out = laid.groupBy(*keys).agg(*figures).withColumns({n: _middle(F.col(n)) for n in values})
    out = out.withColumns({n: F.when(F.col(n) > 0, F.col(n).cast("double")) for n in BOOK_COUNTS.values()})
    return with_market_probs(out)


def _middle(values: Column) -> Column:
    """Median of a list without NULL; NULL for an empty one."""
    ordered, last = F.sort_array(values), F.size(values) - 1
    low, high = F.get(ordered, F.floor(last / 2).cast("int")), F.get(ordered, F.ceil(last / 2).cast("int"))
    return 0.5 * low + 0.5 * high


def _ranked_consensus(quotes: DataFrame, keys: Sequence[str], hits: Mapping[str, tuple[Column, str]], priced: Column) -> DataFrame:
    """The figures of events of any size."""
    picks = [F.when(hit, F.struct(F.lit(n).alias("metric"), F.col(field).alias("value"))) for n, (hit, field) in hits.items()]
    long = quotes.where(priced).select(*keys, F.explode(F.array_compact(F.array(*picks))).alias("_q")).select(*keys, "_q.metric", "_q.value")
    medians = quantiles(long, [*keys, "metric"], "value", {"mid": 0.5})
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == n, F.col("mid"))).alias(n) for n in CONSENSUS])
    lines = ("spread_line", "total_line")
    quoted = {n: F.when(F.col("metric") == n, F.col("value")) for n in lines}
    spreads = long.where(F.col("metric").isin(*lines)).groupBy(*keys).agg(
        *[F.when(F.count(c) >= 2, F.stddev_pop(c)).alias(f"{n}_std") for n, c in quoted.items()]
    )
    wide = join_on(wide, spreads, list(keys))
    # Distinct books by a first grouping: several distinct counts would copy every row per count.
    listed = quotes.groupBy(*keys, "market", "book").agg(F.count(F.lit(1)).alias("_n"))
    books = listed.groupBy(*keys).agg(*[F.sum(F.when(F.col("market") == m, 1).otherwise(0)).alias(n) for m, n in BOOK_COUNTS.items()])
    return join_on(books, wide, list(keys))


def with_market_probs(df: DataFrame) -> DataFrame:
    home, away = american_to_prob(F.col("moneyline_home")), american_to_prob(F.col("moneyline_away"))
    return df.withColumns({"implied_prob_home": home, "implied_prob_away": away, "moneyline_vig": home + away - 1.0})


def snapshot_columns(long: DataFrame, keys: Sequence[str], label: str, metrics: Sequence[str]) -> DataFrame:
    """Snapshot labels from rows to columns, with moves of the cutoff value against the others."""
    wide = long.groupBy(*keys).pivot(label, list(SNAPSHOTS)).agg(*[F.max(m).alias(m) for m in metrics])
    single = len(metrics) == 1
    renamed = wide.select(
        *keys,
        *[
            F.col(f"`{lab}`" if single else f"`{lab}_{m}`").alias(m + suffix)
            for lab, suffix in SNAPSHOTS.items()
            for m in metrics
        ],
    )
    moves = {}
    for lab in MOVES_FROM:
        suffix = "" if lab == "open" else SNAPSHOTS[lab]
        for m in metrics:
            if m in MOVING:
                moves[f"{m}_delta{suffix}"] = F.col(m) - F.col(m + SNAPSHOTS[lab])
        if "moneyline_vig" in metrics:
            moves[f"moneyline_vig_pct_delta{suffix}"] = pct_change(F.col("moneyline_vig"), F.col("moneyline_vig" + SNAPSHOTS[lab]))
    return renamed.withColumns(moves)


def largest_move(df: DataFrame, metric: str) -> DataFrame:
    """Largest absolute move of a metric over the snapshots and the direction of that move."""
    deltas = [F.col(f"{metric}_delta{'' if lab == 'open' else SNAPSHOTS[lab]}") for lab in MOVES_FROM]
    sizes = [F.struct(F.abs(d).alias("size"), F.signum(d).alias("sign")) for d in deltas]
    best = F.array_max(F.filter(F.array(*sizes), lambda e: e["size"].isNotNull()))
    return df.withColumns({f"{metric}_move_max_abs": best["size"], f"{metric}_move_direction": best["sign"]})


def player_consensus(
    quotes: DataFrame,
    players: DataFrame,
    game: str = "game_id",
    name: str = "player_name",
    quoted_name: str = "description",
    start: str = "start_ts",
    snapshot: str = "snapshot_ts",
    lead_minutes: int = 15,
    floor_minutes: int = 5,
    out: str = "odds_anytime_td_price",
) -> DataFrame:
    """Median price of each player in the newest snapshot before the lead time.

    The latest safe time is the start minus the lead, floored to the grid; "no" outcomes are left
    out; names match by their normalised last name inside the game.
    """
    step = floor_minutes * 60_000_000
    safe = F.unix_micros(F.col(start).cast("timestamp")) - lead_minutes * 60_000_000
    safe = (F.floor(safe / step) * step).cast("bigint")
    usable = quotes.where(F.unix_micros(F.col(snapshot).cast("timestamp")) <= safe)
    usable = attach_totals(usable, game, {"_newest": F.max(snapshot)}).where(F.col(snapshot) == F.col("_newest"))
    named = usable.where((F.lower(F.trim("outcome")) != "no") & F.col("price").isNotNull()).withColumn("_key", last_name(F.col(quoted_name)))
    prices = quantiles(named.where(F.length("_key") > 0), [game, "_key"], "price", {out: 0.5})
    return join_on(players.withColumn("_key", last_name(F.col(name))), prices, [game, "_key"]).drop("_key")


def attach_stored_odds(df: DataFrame, odds: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("season", "week", "home_team", "away_team"), drop_missing: bool = False) -> DataFrame:
    """Stored odds per game with ``has_odds``: 1 where any of the columns is known, else 0."""
    newest = latest_by(odds, list(keys), [F.col("odds_snapshot_ts")], [*columns, "odds_snapshot_ts"]) if "odds_snapshot_ts" in odds.columns else odds.dropDuplicates(list(keys))
    joined = join_on(df, newest, list(keys))
    present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    joined = joined.withColumns({"has_odds": F.when(present, 1).otherwise(0)})
    return joined.where(F.col("has_odds") == 1) if drop_missing else joined


def coalesce_update(df: DataFrame, update: DataFrame, keys: Sequence[str], columns: Sequence[str], prefer_new: bool = True) -> DataFrame:
    """Overwrite or fill columns from a second frame, one copy of each column in the result."""
    renamed = update.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = join_on(df, renamed, list(keys))
    have = set(df.columns)

    def merged(c: str) -> Column:
        new = F.col(f"__new_{c}")
        if c not in have:
            return new
        return F.coalesce(new, F.col(c)) if prefer_new else F.coalesce(F.col(c), new)

    return joined.withColumns({c: merged(c) for c in columns}).drop(*[f"__new_{c}" for c in columns])


def fill_empty_rows(df: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill only rows whose whole column set is NULL; other rows stay untouched."""
    renamed = source.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = join_on(df, renamed, list(keys))
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    # The test uses the old values of all columns, so it is fixed before any of them changes.
    joined = joined.withColumn("__empty", empty)
    return joined.withColumns({c: F.when(F.col("__empty"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}).drop(
        "__empty", *[f"__new_{c}" for c in columns]
    )


def override_map(derived: DataFrame, manual: DataFrame, keys: Sequence[str], value: str, team: str = "team") -> DataFrame:
    """Manual value, else derived value, else ``TEAM_<team>``; keys of either side are kept."""
    both = derived.select(*keys, F.col(value).alias("_d")).join(manual.select(*keys, F.col(value).alias("_m")), list(keys), "full")
    clean = lambda c: F.when(F.length(F.trim(c)) > 0, F.upper(F.trim(c)))
    return both.select(*keys, F.coalesce(clean(F.col("_m")), clean(F.col("_d")), F.upper(F.concat(F.lit("TEAM_"), F.col(team)))).alias(value))


def lookup_column(key: Column, table: Mapping[str, str]) -> Column:
    """Map text through a small fixed table; unknown keys pass through."""
    if not table:
        return key
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)
