"""Windows and as-of joins that go on from stored state: a new day reads itself and the state before it.

``RollingStore`` keeps, under one folder,

* ``totals``    the daily sums of every key, one partition a day;
* ``carry``     for some days (cuts), one row per key: running sums of all time and of the season, and the last ``reach`` daily rows (halo);
* ``features``  the rolled ratios of every key and day, one partition a day.

``add_days`` starts from the greatest cut before the first new day. Days that come late start from an earlier cut: the days from
there on are rolled again, and the carries of later cuts with them. Partitions before the chosen cut are neither read nor
written, whatever the length of the history.

``SeededHistory`` keeps a feed by day and, for some days, a seed: the last payload of every key before that day. An as-of join of rows of
some days reads the seed before them and the feed's days between.

Both write whole partitions, so a run that is done again after a failure leaves the same tables. A state row is as large as one
key's sums and halo; one cut is one row per key. ``keep`` says how many cuts stay valid, that is, how late a day may be without a roll from the start.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.keys import as_list, ratio
from ..operators.prior import last_rows
from ..session import cut_lineage

NO_CUT = dt.date(1000, 1, 1)


def _write_days(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``column`` that ``df`` holds."""
    parts = df.repartition(F.col(column))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _cuts(spark: SparkSession, path: str, column: str = "cut") -> list[dt.date]:
    """Days that have a partition, from the names of the folders alone."""
    if not _exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(dt.date.fromisoformat(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}="))


class RollingStore:
    """Rolling, season and lifetime ratios of daily totals, kept up to date day by day."""

    def __init__(self, spark: SparkSession, path: str, keys: str | Sequence[str], stats: Sequence[str], windows: Sequence[int] = (1, 3, 5), season: str = "season", keep: int = 8) -> None:
        self.spark, self.path, self.keys, self.season, self.keep = spark, path.rstrip("/"), as_list(keys), season, keep
        self.stats, self.windows, self.reach = list(stats), sorted(windows), max(windows)
        self.sums = [*self.stats, "denom"]

    def _table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def features(self) -> DataFrame:
        return self.spark.read.parquet(self._table("features"))

    def start_of(self, first: dt.date) -> dt.date | None:
        """The greatest valid cut before a day."""
        return max((c for c in _cuts(self.spark, self._table("carry"))[-self.keep :] if c < first), default=None)

    def pending(self, start: dt.date | None) -> DataFrame:
        """Stored daily totals after a cut; a filter on the partition column, so earlier days are not listed."""
        totals = self.spark.read.parquet(self._table("totals"))
        return totals if start is None else totals.where(F.col("day") > F.lit(start))

    def add_days(self, totals: DataFrame) -> dt.date | None:
        """Add daily totals ``keys, day, season, <stats>, denom`` of any days; a day that is given again is replaced.

        Returns the cut that the run started from.
        """
        columns = [*self.keys, "day", self.season, *self.sums]
        new = totals.select(*columns)
        days = new.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        if days["a"] is None:
            return None
        start = self.start_of(days["a"])
        _write_days(new, self._table("totals"), "day")
        rolled = cut_lineage(self.rolled(start))
        ratios = [c for c in rolled.columns if c.endswith("_ratio")]
        _write_days(rolled.where("_kind = 1").select(*self.keys, "day", self.season, *ratios), self._table("features"), "day")
        # Carries of the cuts after the start are made anew, and one for the last day.
        last = max(days["b"], *[c for c in _cuts(self.spark, self._table("carry")) if start is None or c > start], NO_CUT)
        cuts = sorted({c for c in _cuts(self.spark, self._table("carry")) if start is None or c > start} | {last})
        carried = reduce(DataFrame.unionByName, [self._carry(rolled, cut) for cut in cuts])
        _write_days(carried, self._table("carry"), "cut")
        return start

    def _base(self, start: dt.date | None) -> DataFrame | None:
        """Rows that stand for all days up to the start: running sums as the earliest row of a key, then its halo."""
        if start is None:
            return None
        held = self.spark.read.parquet(self._table("carry")).where(F.col("cut") == F.lit(start))
        zero = [F.lit(0.0).alias(f"_{p}_{s}") for p in ("all", "now") for s in self.sums]
        sums = [F.col(f"{p}_{s}").alias(f"_{p}_{s}") for p in ("all", "now") for s in self.sums]
        before = held.select(*self.keys, F.lit(NO_CUT).alias("day"), F.col(f"last_{self.season}").alias(self.season), *[F.lit(None).cast("double").alias(s) for s in self.sums], *sums, F.lit(-1).alias("_kind"))
        halo = held.select(*self.keys, F.explode("halo").alias("_h"))
        halo = halo.select(*self.keys, "_h.day", F.col(f"_h.{self.season}"), *[F.col(f"_h.{s}") for s in self.sums], *zero, F.lit(0).alias("_kind"))
        return before.unionByName(halo)

    def rolled(self, start: dt.date | None) -> DataFrame:
        """All rows after the start (``_kind`` 1) with their ratios, and the rows of the state before them; one move by key."""
        rows = self.pending(start)
        sums = [F.col(s).cast("double").alias(f"_{p}_{s}") for p in ("all", "now") for s in self.sums]
        rows = rows.select(*self.keys, "day", self.season, *[F.col(s).cast("double").alias(s) for s in self.sums], *sums, F.lit(1).alias("_kind"))
        base = self._base(start)
        rows = rows if base is None else rows.unionByName(base)
        # Day and kind order the rows; the running sums come first, and a frame of rows that reaches them adds nothing.
        by_key = Window.partitionBy(*self.keys).orderBy("day", "_kind")
        before = by_key.rowsBetween(Window.unboundedPreceding, -1)
        in_season = Window.partitionBy(*self.keys, self.season).orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, -1)
        made: dict[str, Column] = {}
        for s in self.stats:
            for n in self.windows:
                over = last_rows(by_key, n)
                made[f"{s}_l{n}_ratio"] = ratio(F.sum(s).over(over), F.sum("denom").over(over))
            made[f"{s}_lifetime_ratio"] = ratio(F.sum(f"_all_{s}").over(before), F.sum("_all_denom").over(before))
            made[f"{s}_season_ratio"] = ratio(F.sum(f"_now_{s}").over(in_season), F.sum("_now_denom").over(in_season))
        return rows.withColumns(made)

    def _carry(self, rolled: DataFrame, cut: dt.date) -> DataFrame:
        """State of every key after a day."""
        known = rolled.where(F.col("day") <= F.lit(cut))
        seasons = known.groupBy(*self.keys, self.season).agg(*[F.sum(f"_{p}_{s}").alias(f"{p}_{s}") for p in ("all", "now") for s in self.sums])
        latest = F.max_by(F.struct(*[F.col(f"now_{s}") for s in self.sums]), F.col(self.season)).alias("_n")
        state = seasons.groupBy(*self.keys).agg(F.max(self.season).alias(f"last_{self.season}"), latest, *[F.sum(f"all_{s}").alias(f"all_{s}") for s in self.sums])
        state = state.select(*self.keys, f"last_{self.season}", *[f"all_{s}" for s in self.sums], *[F.col(f"_n.now_{s}").alias(f"now_{s}") for s in self.sums])
        recent = known.where("_kind >= 0").withColumn("_k", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col("day").desc()))).where(F.col("_k") <= self.reach)
        halo = recent.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct("day", self.season, *self.sums))).alias("halo"))
        same = reduce(lambda a, b: a & b, [state[k].eqNullSafe(halo[k]) for k in self.keys])
        joined = state.join(halo, same).drop(*[halo[k] for k in self.keys])
        return joined.withColumn("cut", F.lit(cut))


class SeededHistory:
    """A feed kept by day, with seeds from which an as-of join of some days starts."""

    def __init__(self, spark: SparkSession, path: str, keys: str | Sequence[str], ts: str, columns: Sequence[str]) -> None:
        self.spark, self.path, self.keys, self.ts, self.columns = spark, path.rstrip("/"), as_list(keys), ts, list(columns)

    def _feed(self) -> str:
        return f"{self.path}/feed"

    def _seeds(self) -> str:
        return f"{self.path}/seeds"

    def add(self, feed: DataFrame) -> None:
        """Add rows of the feed; the days that they fall on are written whole, so give whole days.

        Seeds of days after the first new one are made anew, and one for the day after the last.
        """
        rows = feed.where(F.col(self.ts).isNotNull()).select(*self.keys, self.ts, *self.columns, F.to_date(self.ts).alias("day"))
        days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        if days["a"] is None:
            return
        _write_days(rows, self._feed(), "day")
        old = [c for c in _cuts(self.spark, self._seeds(), "seed")]
        start = max((c for c in old if c <= days["a"]), default=None)
        cuts = sorted({c for c in old if c > days["a"]} | {days["b"] + dt.timedelta(days=1)})
        made = reduce(DataFrame.unionByName, [self._seed(start, cut) for cut in cuts])
        _write_days(made, self._seeds(), "seed")

    def between(self, start: dt.date | None, upto: dt.date) -> DataFrame:
        """The seed of a day and the feed from that day to before ``upto``."""
        feed = self.spark.read.parquet(self._feed()).where(F.col("day") < F.lit(upto))
        feed = (feed if start is None else feed.where(F.col("day") >= F.lit(start))).select(*self.keys, self.ts, *self.columns)
        if start is None:
            return feed
        seed = self.spark.read.parquet(self._seeds()).where(F.col("seed") == F.lit(start))
        return feed.unionByName(seed.select(*self.keys, self.ts, *self.columns))

    def _seed(self, start: dt.date | None, cut: dt.date) -> DataFrame:
        row = F.struct(self.ts, *self.columns)
        last = self.between(start, cut).groupBy(*self.keys).agg(F.max_by(row, row).alias("_l"))
        return last.select(*self.keys, "_l.*", F.lit(cut).alias("seed"))

    def known_to(self, first: dt.date, last: dt.date) -> DataFrame:
        """All of the feed that an as-of join of rows from ``first`` to ``last`` can match: a seed and the days after it."""
        start = max((c for c in _cuts(self.spark, self._seeds(), "seed") if c <= first), default=None)
        return self.between(start, last + dt.timedelta(days=1))

    def attach(self, rows: DataFrame, ts: str, allow_exact: bool = True, matched_ts: str | None = "matched_ts") -> DataFrame:
        """``rows`` with the feed's latest payload at or before their time. The span of ``rows`` is asked for first."""
        span = rows.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b")).first()
        if span["a"] is None:
            span = {"a": NO_CUT, "b": NO_CUT}
        feed = self.known_to(span["a"], span["b"]).withColumnRenamed(self.ts, "_feed_ts")
        return asof_join(rows, feed, self.keys, ts, "_feed_ts", self.columns, allow_exact=allow_exact, matched_ts=matched_ts)
