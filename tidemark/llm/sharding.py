"""Cut documents into shards by the smallest feasible capacity (minimax contiguous partition), with DataFrame operations only.

Documents with equal texts form atomic groups. Groups stand in the order of their text digest; the smallest capacity for
which a greedy walk over the ordered group sizes needs no more than the given number of shards is searched by halving
(many capacities a round), and the greedy cuts at that capacity are the shards. No contiguous partition of the same order
has a smaller largest shard.

How it scales: group sizes are summed before any ordering; running sums are taken inside digest bins and between bins, so
no task orders the whole table. The driver sees one pair of totals per bin (``MAX_BINS`` rows at most) and, for each
greedy step, one row with the furthest group end of each capacity tried; a step scans only the bins that its ends fall in.
A group that holds a third of all rows is one row in the search, and its rows are numbered in many hash cells.

Defined results: a null text has size 1 and code 0, as the empty text, and is in its group; fewer groups than leave the last shards empty; repeated rows take one slot each; null document ids come first in their cell; an
empty table gives no rows. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, text_crc32

MAX_BINS = 4096
BIN_ROWS = 20_000
#: Rows that one hash cell of a group holds on average, when a group holds all rows.
CELL_ROWS = 2_000
#: Capacities tried at once.
TRIED = 64


def _greedy(groups: DataFrame, starts: list[int], ends: list[int], capacities: list[int], shards: int) -> list[list[int]]:
    """Cut positions (running bytes) of a greedy walk for each capacity; one aggregate per step."""
    total = ends[-1]
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        open_ = [k for k, here in enumerate(at) if here < total]
        asks = {}
        for k in open_:
            reach = at[k] + capacities[k]
            if reach >= total:
                at[k] = total
                cuts[k].append(total)
            else:
                asks[k] = (bisect_right(ends, reach), reach)
        if not asks:
            break
        found = (
            groups.where(F.col("bin").isin(sorted({b for b, _ in asks.values()})))
            .agg(*[F.max(F.when((F.col("bin") == b) & (F.col("upto") <= reach - starts[b]), F.col("upto"))).alias(f"c{k}") for k, (b, reach) in asks.items()])
            .first()
        )
        for k, (b, _) in asks.items():
            inside = found[f"c{k}"]
            at[k] = starts[b] + (inside or 0)
            cuts[k].append(at[k])
    return [c if here >= total else [] for c, here in zip(cuts, at, strict=True)]


def smallest_capacity(groups: DataFrame, bin_bytes: list[int], largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest shard capacity that suffices, and the running bytes at which its greedy walk cuts."""
    ends, total = [], 0
    for b in bin_bytes:
        total += b
        ends.append(total)
    starts = [e - b for e, b in zip(ends, bin_bytes, strict=True)]
    low = max(largest, -(-total // shards))  # no smaller one can do
    high = -(-total // shards) + largest  # always does
    best = high
    cuts: list[int] = []
    while low <= high:
        step = max(1, -(-(high - low + 1) // TRIED))
        tried = list(range(low, high + 1, step))
        if tried[-1] != high:
            tried.append(high)
        walks = _greedy(groups, starts, ends, tried, shards)
        first = next(k for k, w in enumerate(walks) if w)
        best, cuts = tried[first], walks[first]
        if step == 1 or first == 0:
            break
        low, high = tried[first - 1] + 1, tried[first]
    return best, cuts


def shard_documents(docs: DataFrame, shards: int = 8, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, shard, slot``; sizes are UTF-8 bytes plus one."""
    body = F.col(text)
    rows = cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
            text_crc32(body).alias("text_crc32"),
            F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256).alias("digest"),
        )
    )
    count = rows.count()
    bins = min(MAX_BINS, max(16, -(-count // BIN_ROWS)))
    cell_count = max(1, -(-count // CELL_ROWS))
    rows = rows.withColumns(
        {
            "bin": F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * bins / float(1 << 32)).cast("int"),
            "cell": F.pmod(F.xxhash64("doc_id"), F.lit(cell_count)),
        }
    )
    cells = cut_lineage(rows.groupBy("bin", "digest", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    in_bin = Window.partitionBy("bin").orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = cells.groupBy("bin", "digest").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    groups = cut_lineage(groups.withColumn("upto", F.sum("bytes").over(in_bin)).withColumn("rows_upto", F.sum("n").over(in_bin)))
    totals = {r["bin"]: r for r in groups.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("largest")).collect()}
    bin_bytes = [totals[b]["bytes"] if b in totals else 0 for b in range(bins)]
    _, cuts = smallest_capacity(groups, bin_bytes, max((t["largest"] for t in totals.values()), default=0), shards) if totals else (0, [])
    # Bytes and rows before each bin, and the shard of each group by the cuts before its end.
    per_bin = groups.groupBy("bin").agg(F.sum("bytes").alias("_b"), F.sum("n").alias("_n"))
    ahead = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.select("bin", F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("rows_ahead"))
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("bytes_ahead") + F.col("upto") > F.lit(cut)).cast("int")
    placed = groups.join(per_bin, "bin").select("bin", "digest", shard.cast("int").alias("shard"), (F.col("rows_ahead") + F.col("rows_upto") - F.col("n")).alias("rows_before"))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_rows_before"))
    placed = placed.join(first, "shard").select("bin", "digest", "shard", (F.col("rows_before") - F.col("shard_rows_before")).alias("group_slot"))
    in_group = Window.partitionBy("bin", "digest").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("cell_slot", F.coalesce(F.sum("n").over(in_group), F.lit(0))).drop("bytes", "n")
    offsets = offsets.join(placed, ["bin", "digest"])
    in_cell = Window.partitionBy("bin", "digest", "cell").orderBy("doc_id")
    out = rows.join(offsets, ["bin", "digest", "cell"]).withColumn("slot", F.col("group_slot") + F.col("cell_slot") + F.row_number().over(in_cell) - 1)
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, *, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write ``doc_id, text`` as one folder per shard; a repeated id with different texts goes by id and text code."""
    placed = shard_documents(docs, shards, text=text, doc_id=doc_id).select("doc_id", "text_crc32", "shard").distinct()
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_crc32(F.col(text)).alias("text_crc32"))
    same = body.alias("b").join(placed.alias("p"), F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("b.text_crc32") == F.col("p.text_crc32")))
    same.select("b.doc_id", "b.text", "p.shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
