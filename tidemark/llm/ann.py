"""Nearest neighbours by largest inner product: inverted lists with an adaptive scan over dimensions.

Every vector gets one more component that makes all lengths equal; the largest inner product is then the smallest
distance. Vectors are turned by a random rotation, so that any first d of D dimensions hold about d/D of a squared
distance, and are dealt to lists by their nearest centre. A query scans the lists of its nearest centres. Within a list
the rotated dimensions stand in column blocks; after each block a candidate is given up if its partial distance, scaled up to
D dimensions, exceeds the query's k-th best distance by the factor ``(1 + EPSILON / sqrt(d))^2`` (a test that a random
rotation fails for a true neighbour with small probability). The queries of a list are scanned together. Candidates that survive all blocks are scored exactly, in
double precision, on the original vectors.

How many lists a query scans is measured, not guessed: for ``TRIALS`` queries the true neighbours are found by brute force
in one pass, and the smallest number of nearest lists is taken that holds ``RECALL`` of them.

How it scales: the centres are fitted on a bounded sample (``SAMPLE`` vectors) and there are at most ``MAX_LISTS`` of them,
so they travel with the function. All vectors are indexed, once, in a written table. Long lists are cut into blocks of
``BLOCK_ROWS`` rows and the queries of a list into parts of ``PART_ROWS``, so one list that holds a third of all vectors is
many tasks. Every block returns at most k rows for each query.

Defined results: vectors that are null, empty, zero, of another length than most, or with a null or non-finite component
take no part; a query never finds rows with its own id; equal scores go by the smaller id; a repeated query id is asked
once; fewer candidates than k are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.session import cut_lineage

SAMPLE = 16_384
MAX_LISTS = 16_384
BLOCK_ROWS = 8_192
PART_ROWS = 1_024
#: Dimensions in a column block, and the strictness of the test.
WIDTH = 16
EPSILON = 2.1
#: Partial distances that are held together, the share of pairs (one in so many) below which they go on one by one, and pairs scored together.
TOGETHER = 1 << 18
FEW = 16
SCORED = 1 << 14
#: Queries for which the number of lists is measured, and the share of true neighbours that the lists must hold.
TRIALS = 128
RECALL = 0.96


def usable(vector: Column) -> Column:
    """Vectors that take part: some component, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


class Geometry:
    """The added component, the rotation and the centres."""

    def __init__(self, longest: float, dims: int, centres: np.ndarray | None = None, seed: int = 11) -> None:
        self.longest, self.dims = longest, dims
        turned = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims + 1, dims + 1)))[0]
        self.rotation = turned
        self.centres = centres

    def lifted(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Rotated vectors of one length; queries are scaled to it and get no added component."""
        squares = np.einsum("ij,ij->i", vectors, vectors)
        if queries:
            added = np.zeros(len(vectors))
            vectors = vectors * (self.longest / np.sqrt(squares))[:, None]
        else:
            added = np.sqrt(np.maximum(0.0, self.longest**2 - squares))
        return np.concatenate([vectors, added[:, None]], axis=1) @ self.rotation

    def nearest_lists(self, lifted: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, less the vectors' own length."""
        return np.einsum("ij,ij->i", self.centres, self.centres) - 2 * lifted @ self.centres.T


def fit_centres(lifted: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds; equal vectors count once."""
    distinct = np.unique(lifted.round(9), axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        near = np.concatenate([(np.einsum("ij,ij->i", centres, centres) - 2 * distinct[k : k + 4096] @ centres.T).argmin(axis=1) for k in range(0, len(distinct), 4096)])
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, distinct)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


def fit(vectors: DataFrame, lists: int | None = None) -> Geometry | None:
    """Geometry of a table ``vec_id, vec``: two aggregates and a bounded sample."""
    lengths = vectors.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"))
    most = lengths.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return None
    share = min(1.0, 0.9 * SAMPLE / most["n"])
    chosen = vectors.where((F.size("vec") == most["dims"]) & (F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) <= share * (1 << 30))).select("vec").limit(SAMPLE)
    sample = np.array([r[0] for r in chosen.collect()], np.float64).reshape(-1, most["dims"])
    geometry = Geometry(math.sqrt(most["longest"]), most["dims"])
    lists = lists or min(MAX_LISTS, max(1, round(math.sqrt(most["n"]))), max(1, len(sample) // 4))
    geometry.centres = fit_centres(geometry.lifted(sample), lists) if len(sample) else np.zeros((1, most["dims"] + 1))
    return geometry


def build_index(vectors: DataFrame, geometry: Geometry) -> DataFrame:
    """``vec_id, vec, list, turned`` of all vectors, written once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = geometry.lifted(matrix(batch.column("vec"), geometry.dims))
            near = np.concatenate([geometry.nearest_lists(lifted[k : k + 2048]).argmin(axis=1) for k in range(0, len(lifted), 2048)] or [np.zeros(0, int)])
            turned = pa.FixedSizeListArray.from_arrays(pa.array(lifted.astype(np.float32).reshape(-1)), geometry.dims + 1).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vec": batch.column("vec"), "list": pa.array(near, pa.int32()), "turned": turned})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return cut_lineage(vectors.where(F.size("vec") == geometry.dims).mapInArrow(listed, f"vec_id {kind}, vec array<double>, list int, turned array<float>"))


def lists_needed(index: DataFrame, queries: DataFrame, geometry: Geometry, k: int) -> int:
    """The smallest number of nearest lists that holds ``RECALL`` of the true neighbours of ``TRIALS`` queries."""
    tried = queries.orderBy(F.xxhash64(F.lit("try"), "query_id"), "query_id").limit(TRIALS).collect()
    if not tried:
        return 1
    vectors = np.array([r["q"] for r in tried], np.float64)
    own = [r["query_id"] for r in tried]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = vectors @ matrix(batch.column("vec"), geometry.dims).T
            for i, query in enumerate(own):
                score[i, pc.fill_null(pc.equal(batch.column("vec_id"), pa.scalar(query)), False).to_numpy(zero_copy_only=False)] = -np.inf
            near = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            query, row = np.repeat(np.arange(len(own)), near.shape[1]), near.reshape(-1)
            yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int32()), "list": batch.column("list").take(pa.array(row)), "score": pa.array(score[query, row])})

    found = index.select("vec_id", "vec", "list").mapInArrow(best, "query int, list int, score double").where(F.col("score") > float("-inf"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= k).collect()
    order = np.argsort(geometry.nearest_lists(geometry.lifted(vectors, queries=True)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["query"], r["list"]] for r in found])
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1 if len(needed) else 1


def _probes(queries: DataFrame, geometry: Geometry, sizes: np.ndarray, probe: int, least: int) -> DataFrame:
    """``query_id, q, turned, list`` for the nearest lists of every query that hold ``least`` rows or more together."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("q"), geometry.dims)
            for k in range(0, len(vectors), 1024):
                lifted = geometry.lifted(vectors[k : k + 1024], queries=True)
                order = np.argsort(geometry.nearest_lists(lifted), axis=1, kind="stable")
                order = [o[: max(probe, int(np.searchsorted(np.cumsum(sizes[o]), least)) + 1)] for o in order]
                owner = np.repeat(np.arange(len(order)), [len(o) for o in order])
                part = batch.slice(k, len(lifted)).take(pa.array(owner))
                turned = pa.FixedSizeListArray.from_arrays(pa.array(lifted[owner].astype(np.float32).reshape(-1)), geometry.dims + 1).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_pydict({"query_id": part.column("query_id"), "q": part.column("q"), "turned": turned, "list": pa.array(np.concatenate(order), pa.int32())})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(probed, f"query_id {kind}, q array<double>, turned array<float>, list int")


def scan(blocks: list[np.ndarray], queries: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a row of a list that survive the adaptive scan, in the order of the queries.

    ``blocks`` are (dimensions, rows), ``wanted`` is k for each query. Queries go together, ``TOGETHER`` distances at a time:
    partial distances of a block are one product of matrices, until few pairs are left, which go on one by one.
    """
    dims, rows = queries.shape[1], blocks[0].shape[1]
    row = np.arange(rows)
    # The first rows in full give the bound.
    seeds = np.minimum(rows, np.maximum(4 * wanted, 64))
    squares = [np.einsum("dr,dr->r", block, block) for block in blocks]
    ends = np.cumsum([len(block) for block in blocks]).tolist()
    step = max(1, TOGETHER // max(1, rows))
    for a in range(0, len(queries), step):
        asked, seed = queries[a : a + step], seeds[a : a + step, None]
        parts = [asked[:, end - len(block) : end] for block, end in zip(blocks, ends, strict=True)]
        lengths = [np.einsum("qd,qd->q", part, part)[:, None] for part in parts]
        first = int(seed.max())
        full = sum(square[:first] + length - 2 * (part @ block[:, :first]) for block, square, part, length in zip(blocks, squares, parts, lengths, strict=True))
        bound = np.sort(np.where(row[:first] < seed, full, np.inf), axis=1)[np.arange(len(asked)), wanted[a : a + step] - 1]
        spare = 1e-12 * (1 + sum(lengths)[:, 0])  # products of matrices lose digits of short distances
        near, query, left = np.ones((len(asked), rows), bool), None, None
        partial = np.zeros((len(asked), rows))
        for block, square, part, length, end in zip(blocks, squares, parts, lengths, ends, strict=True):
            strict = 1.0 if end == dims else end / dims * (1 + EPSILON / math.sqrt(end)) ** 2
            limit = bound * strict * (1 + 1e-6) + spare
            if left is None:
                partial += square + length - 2 * (part @ block)
                stays = partial <= limit[:, None]
                if end < dims:
                    stays |= row < seed
                near &= stays
                if FEW * np.count_nonzero(near) < near.size:
                    query, left = np.nonzero(near)
                    partial = partial[query, left]
            else:
                partial = partial + np.square(block[:, left] - part.T[:, query]).sum(axis=0)
                stays = partial <= limit[query]
                if end < dims:
                    stays |= left < seed[query, 0]
                query, left, partial = query[stays], left[stays], partial[stays]
        if left is None:
            query, left = np.nonzero(near)
        yield a + query, left


def search(index: DataFrame, queries: DataFrame, geometry: Geometry, k: int = 20, probe: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows found for each query (``query_id, q``)."""
    ship(index.sparkSession)
    lists = len(geometry.centres)
    queries = queries.dropDuplicates(["query_id"])
    probe = probe or lists_needed(index, queries, geometry, k)
    counted = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    sizes = np.array([counted.get(x, 0) for x in range(lists)])
    asked = cut_lineage(_probes(queries, geometry, sizes, probe, 4 * k + 1))
    per_list = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    per_list = index.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).join(per_list, "list")
    per_list = F.broadcast(per_list.select("list", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("asked") / PART_ROWS).cast("int").alias("parts")))
    rows = index.join(per_list, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = asked.join(per_list, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        n = left.num_rows
        if n and right.num_rows:
            ids, vectors = left["vec_id"].combine_chunks(), matrix(left["vec"], geometry.dims)
            turned = np.ascontiguousarray(matrix(left["turned"], geometry.dims + 1).T)
            blocks = [turned[d : d + WIDTH] for d in range(0, len(turned), WIDTH)]
            asked_vectors, asked_turned = matrix(right["q"], geometry.dims), matrix(right["turned"], geometry.dims + 1)
            order = pc.rank(ids, tiebreaker="first").to_numpy()
            own = right["query_id"].combine_chunks()
            names = pc.drop_null(pc.unique(ids))
            row_name, own_name = (pc.fill_null(pc.index_in(x, value_set=names), none).to_numpy(zero_copy_only=False) for x, none in ((ids, len(names)), (own, -1)))
            # Rows with a query's own id are left out, so that many more are wanted.
            mine = np.bincount(row_name, minlength=len(names) + 1)[own_name] * (own_name >= 0)
            for query, near in scan(blocks, asked_turned, np.minimum(n, k + mine)):
                others = row_name[near] != own_name[query]
                query, near = query[others], near[others]
                score = np.concatenate([np.zeros(0), *((vectors[near[a : a + SCORED]] * asked_vectors[query[a : a + SCORED]]).sum(axis=1) for a in range(0, len(near), SCORED))])
                best = np.lexsort((order[near], -score, query))
                query = query[best]
                kept = np.arange(len(best)) - np.searchsorted(query, query) < k
                query, best = query[kept], best[kept]
                out.append(pa.table({"query_id": own.take(pa.array(query)), "vec_id": ids.take(pa.array(near[best])), "score": pa.array(score[best])}))
        empty = pa.table({"query_id": right["query_id"].slice(0, 0), "vec_id": left["vec_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), index.schema["vec_id"].dataType.simpleString()
    keys = ("list", "block", "part")
    pairs = rows.select(*keys, "vec_id", "vec", "turned").groupBy(*keys).cogroup(parts.select(*keys, "query_id", "q", "turned").groupBy(*keys))
    hits = pairs.applyInArrow(found, f"query_id {kind}, vec_id {id_kind}, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", probe: int | None = None) -> DataFrame:
    """The k nearest rows of every row of ``table`` that ``is_query`` picks, against all rows."""
    spark = table.sparkSession
    ship(spark)
    body = F.transform(F.col(vector), lambda x: x.cast("double"))
    vectors = table.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), body.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    geometry = fit(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if geometry is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = build_index(vectors.select("vec_id", "vec"), geometry)
    queries = vectors.where(F.col("asked") & (F.size("vec") == geometry.dims)).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return search(index, queries, geometry, k, probe)
