"""Mix sources to target weights by Pareto order sampling.

Sources get word targets from repeating weights; a target never exceeds ``max_copies`` times its source, and what it
would exceed goes to the other sources by weight. A document's expected copies follow from its source's target and its own
weight. The whole part of them is certain. For the rest each document draws one random number u and is ranked by
``odds(u) / odds(inclusion)``; documents are taken in that order until the words that are still wanted are reached, so
the sample has a fixed size (in words, to within half a document) and unequal inclusion probabilities.

How it scales: the words are counted once and only narrow rows are written for the later steps. The place where a
source's ranking is cut is found in two levels (sums per rank bin, then the rows of the one bin that the cut falls in), so
a source that holds a third of all rows is never ranked in one task; rows without a rest, as all of a capped source, are not ranked. The decision for a row then needs only its source's
cut, a small table, so documents are never joined back and never shuffled.

Defined results: a null text has size 0; null is a source of its own, last in order; documents of size 0 take nothing;
rows that agree in document id, source and text are taken or left together; null document ids count as one id; an empty
table gives no rows; other columns are kept as they are by ``mixed_documents`` and dropped by ``mix_sources``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, word_count

#: Rows of one rank bin; a source has as many bins as it needs.
BIN_ROWS = 2_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """Word target of every source: ``source, source_size`` in, ``target`` added.

    Sources by code point, null last, take ``weights`` in turn. Targets are ``min(max_copies * size, level * weight)`` with
    the one level at which they add up to ``share`` of all words; ordered by ``cap / weight``, the capped sources come
    first, so running sums give the level without a loop. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(order))
    ranked = ranked.withColumn("_w", F.element_at(ring, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / left)
    level = level.withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_w"))
    # Levels rise up to the first open source and fall after it.
    level = level.withColumn("_at", F.max(F.when(F.col("_open"), F.col("_level"))).over(every))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap")))
    return level.select("source", "source_size", target.alias("target"))


def _draw(doc_id: Column, seed: str) -> Column:
    """Random number in (0, 1) of a document: 48 bits of a digest of its id, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _narrow(docs: DataFrame, text: str, doc_id: str, source: str, weight: Column | None, seed: str) -> list[Column]:
    return [
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1)).alias("_crc"),
        _draw(F.col(doc_id), seed).alias("_u"),
        (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("_weight"),
    ]


def _ranked(rows: DataFrame, plan: DataFrame, max_copies: int) -> DataFrame:
    """Certain copies and Pareto rank value of every row."""
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = F.when(F.col("_weighted") > 0, F.least(F.lit(float(max_copies)), F.col("target") * F.col("_weight") / F.col("_weighted"))).otherwise(0.0)
    rows = rows.withColumn("_copies", copies).withColumn("_sure", F.floor("_copies").cast("long"))
    rest = F.col("_copies") - F.col("_sure")
    odds = rest / (1 - rest)
    # A document without any rest ranks behind all others.
    value = F.when(odds > 0, F.col("_u") / (1 - F.col("_u")) / odds).otherwise(F.lit(float("inf")))
    return rows.withColumn("_rank", value)


def mix_plan(rows: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """One row per source: target, weighted size and the rank, id and text code up to which its documents are taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_weight")).alias("_weighted"), F.count(F.lit(1)).alias("_rows"))
    sizes = cut_lineage(sizes)
    plan = source_targets(sizes.select("source", "source_size"), weights, share, max_copies)
    plan = plan.join(sizes.select(F.col("source").alias("_source"), "_weighted", "_rows"), F.col("source").eqNullSafe(F.col("_source")))
    plan = cut_lineage(plan.select("_source", "source_size", "target", "_weighted", "_rows"))
    ranked = _ranked(rows, plan, max_copies)
    # Monotone in the rank, and uniform where a source's documents weigh alike.
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = mean - F.floor(mean)
    odds = F.greatest(mean / (1 - mean), F.lit(1e-12))
    even = F.when(F.col("_rank") == float("inf"), 1.0).otherwise(F.col("_rank") * odds / (1 + F.col("_rank") * odds))
    bins = F.ceil(F.col("_rows") / float(BIN_ROWS))
    ranked = ranked.withColumn("_bin", F.least(F.floor(even * bins), bins - 1).cast("long"))
    # A document can be taken once more only below max_copies, and only if it has a rest: those with one hold all wanted words.
    can = (F.col("_sure") < max_copies) & (F.col("_rank") < float("inf"))
    ranked = ranked.withColumn("_more", F.when(can, F.col("size")).otherwise(0))
    cells = ranked.groupBy("source", "_bin").agg(F.sum("_more").alias("_more"), F.sum(F.col("size") * F.col("_sure")).alias("_sure"), F.first("target").alias("target"))
    whole = Window.partitionBy("source")
    cells = cells.withColumn("_wanted", F.col("target") - F.sum("_sure").over(whole))
    cells = cells.withColumn("_upto", F.sum("_more").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The cut falls in the first bin that reaches the wanted words; the last bin, if none does.
    reach = F.min(F.when(F.col("_upto") >= F.col("_wanted"), F.col("_bin"))).over(whole)
    cells = cells.withColumn("_cut", F.coalesce(reach, F.max("_bin").over(whole))).where(F.col("_bin") == F.col("_cut"))
    cells = cells.select(F.col("source").alias("_cs"), F.col("_cut"), (F.col("_wanted") - (F.col("_upto") - F.col("_more"))).alias("_want"))
    # Sources taken whole, capped ones too, have no rows to rank.
    inside = ranked.where("_more > 0").join(cells, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_bin") == F.col("_cut")))
    inside = inside.groupBy("source", "_cut", "_rank", "doc_id", "_crc").agg(F.sum("_more").alias("_more"), F.first("_want").alias("_want"))
    rows_before = Window.partitionBy("source", "_cut").orderBy("_rank", "doc_id", "_crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_upto", F.sum("_more").over(rows_before))
    fits = inside.where(F.col("_upto") - F.col("_more") / 2 <= F.col("_want"))
    last = fits.groupBy("source").agg(F.max(F.struct("_rank", "doc_id", "_crc")).alias("_last"))
    begun = cells.groupBy("_cs", "_cut").agg(F.first("_want").alias("_want"))
    out = plan.join(begun, F.col("_source").eqNullSafe(F.col("_cs")), "left").join(last.select(F.col("source").alias("_ls"), "_last"), F.col("_source").eqNullSafe(F.col("_ls")), "left")
    return cut_lineage(out.select("_source", "source_size", "target", "_weighted", "_rows", "_cut", "_last"))


def _decided(rows: DataFrame, plan: DataFrame, max_copies: int) -> DataFrame:
    ranked = _ranked(rows, plan, max_copies)
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = mean - F.floor(mean)
    odds = F.greatest(mean / (1 - mean), F.lit(1e-12))
    even = F.when(F.col("_rank") == float("inf"), 1.0).otherwise(F.col("_rank") * odds / (1 + F.col("_rank") * odds))
    bins = F.ceil(F.col("_rows") / float(BIN_ROWS))
    here = F.least(F.floor(even * bins), bins - 1).cast("long")
    in_cut = (here == F.col("_cut")) & F.col("_last").isNotNull() & (F.struct("_rank", "doc_id", "_crc") <= F.col("_last"))
    more = (F.col("_sure") < max_copies) & (F.coalesce(here < F.col("_cut"), F.lit(False)) | F.coalesce(in_cut, F.lit(False)))
    return ranked.withColumn("copies", F.when(F.col("size") > 0, F.col("_sure") + more.cast("long")).otherwise(0))


def mix_sources(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """Copies that the mix takes of every document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``weight`` (a column, 1 by default) raises or lowers a document's inclusion odds within its source.
    """
    rows = cut_lineage(docs.select(_narrow(docs, text, doc_id, source, weight, seed)))
    out = _decided(rows, mix_plan(rows, weights, share, max_copies), max_copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, with all its columns."""
    narrow = _narrow(docs, text, doc_id, source, weight, seed)
    rows = cut_lineage(docs.select(narrow))
    plan = mix_plan(rows, weights, share, max_copies)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *narrow)
    out = _decided(wide, plan, max_copies).where(F.col("copies") > 0)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select([F.col("_row").getField(c).alias(c) for c in docs.columns])
