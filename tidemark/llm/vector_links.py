"""Embeddings of one label whose cosine reaches a threshold: tiles in order of principal components, with early stops.

Vectors are scaled to length one and rotated to principal components (fitted on ``SAMPLE`` vectors at most; a rotation changes
no cosine, so the sample bears on speed alone). Equal vectors of a label become one with their count. Two tiles are
compared dimension block by dimension block, leading components first: after each block, the product of what is left of two
vectors is bounded by the product of their suffix norms, and a pair is given up as soon as partial product and bound together
stay below the threshold. When few pairs are left they alone are gone on with. Pairs within ``DOUBT`` of the threshold are
decided on the original vectors in double precision. No pair is a row: a tile pair gives each vector's number of links and
its edge to the smallest vector that the tile pair joins it with.

How it scales: vectors are sorted by range over (label, length, leading component) and cut into tiles of ``TILE`` rows or less (and
``TILE_BYTES``), so a label with a third of all rows is many tiles. Vectors that link differ in any component by at most ``sqrt(2 - 2 * threshold)``, hence
only tiles whose intervals of the leading component come that near are joined, found by an equi-join of cells of that width on
names of tiles; vectors travel to a tile pair afterwards, and inside it strips of ``STRIP`` rows are passed over in the same way.
The work of a label without any structure in its leading components grows with the square of its rows, divided over its tile pairs.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and vectors without a label or id,
link with nothing; vectors of different lengths do not link; each row counts as a vector, so repeated rows link with
each other; rows of one id with several vectors are one node of the components, each with the links of its own vector; a null id has
no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.components import connected_components
from tidemark.llm.exchange import table_bytes, table_of
from tidemark.llm.packed import give_back
from tidemark.operators.slices import lookup_join
from tidemark.session import cut_lineage

#: Vectors that the rotation is fitted on.
SAMPLE = 4096
#: Rows and bytes of a tile, rows of a strip of it, and dimensions of a block.
TILE, TILE_BYTES, STRIP, BLOCK = 4096, 2 << 20, 256, 16
#: A pair this near the threshold is computed again on the original vectors; rounding is far less.
DOUBT = 1e-9


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their greatest component, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return F.coalesce((F.size(vector) > 0) & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of the sample's vectors, an orthogonal matrix whose columns go from most to least spread."""
    sample = classes.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").toArrow()["vector"].to_pylist()
    axes = {}
    for size in {len(v) for v in sample}:
        units = unit_vectors(np.array([v for v in sample if len(v) == size], np.float64))
        _, found = np.linalg.eigh(units.T @ units)
        axes[size] = np.ascontiguousarray(found[:, ::-1])
    return axes


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table["vector"].combine_chunks() if isinstance(table, pa.Table) else table.column("vector")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _strips(n: int) -> list[tuple[int, int]]:
    return [(s, min(n, s + STRIP)) for s in range(0, n, STRIP)]


class Side:
    """One tile's vectors, rotated, with the norms of what follows each block."""

    def __init__(self, table: pa.Table, axes: dict[int, np.ndarray]) -> None:
        self.given = _matrix(table)
        units = unit_vectors(self.given.astype(np.float64))
        self.turned = units @ axes[units.shape[1]] if units.shape[1] in axes else units
        self.counts, self.names = table["copies"].to_numpy(), table["vec_id"].to_numpy()
        self.cuts = list(range(0, self.given.shape[1], BLOCK)) + [self.given.shape[1]]
        squares = np.concatenate([np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(self.turned), 1))], axis=1)
        self.rest = np.sqrt(squares[:, self.cuts])
        self.lead = self.turned[:, 0]


def linked(a: Side, rows: tuple[int, int], b: Side, columns: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a strip of ``a`` and a strip of ``b`` that reach the threshold, as places in the strips."""
    x, y, rx, ry = a.turned[slice(*rows)], b.turned[slice(*columns)], a.rest[slice(*rows)], b.rest[slice(*columns)]
    least = threshold - DOUBT
    partial = np.zeros((len(x), len(y)))
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for k, (low, high) in enumerate(zip(a.cuts, a.cuts[1:], strict=False)):
        if pairs is None:
            partial += x[:, low:high] @ y[:, low:high].T
            alive = partial + rx[:, k + 1, None] * ry[None, :, k + 1] >= least
            n = int(alive.sum())
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n * 8 < alive.size:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            partial = partial + np.einsum("ij,ij->i", x[pairs[0], low:high], y[pairs[1], low:high])
            alive = partial + rx[pairs[0], k + 1] * ry[pairs[1], k + 1] >= least
            pairs, partial = (pairs[0][alive], pairs[1][alive]), partial[alive]
    if pairs is None:
        pairs = np.nonzero(partial >= least)
        partial = partial[pairs]
    doubtful = np.flatnonzero(np.abs(partial - threshold) <= DOUBT)
    keep = partial > threshold
    for at in range(0, len(doubtful), STRIP * STRIP):
        some = doubtful[at : at + STRIP * STRIP]
        p, q = a.given[rows[0] + pairs[0][some]].astype(np.float64), b.given[columns[0] + pairs[1][some]].astype(np.float64)
        p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
        keep[some] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= threshold
    return pairs[0][keep], pairs[1][keep]


def tile_links(a: Side, b: Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of every row of ``a`` and ``b`` in the other tile, and the smallest place (``a`` first) joined with each place."""
    n, gap = len(a.given), math.sqrt(max(0.0, 2 - 2 * threshold)) + DOUBT
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.given), np.int64)
    root = np.arange(n if same else n + len(b.given))
    shift = 0 if same else n
    for rows in _strips(n):
        low, high = a.lead[slice(*rows)].min() - gap, a.lead[slice(*rows)].max() + gap
        for columns in _strips(len(b.given)):
            lead = b.lead[slice(*columns)]
            if lead.max() < low or lead.min() > high or (same and columns[0] < rows[0]):
                continue
            p, q = linked(a, rows, b, columns, threshold)
            p, q = p + rows[0], q + columns[0]
            if same:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            np.add.at(links_a, p, b.counts[q])
            np.add.at(links_a if same else links_b, q, a.counts[p])
            _join(root, p, q + shift)
    return links_a, links_b, root


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the components of all pairs; ``root`` has the smallest place of each component."""
    while True:
        x, y = root[p], root[q]
        apart = x != y
        if not apart.any():
            return
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def vector_links(rows: DataFrame, threshold: float = 0.98, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id`` of every row: vectors of its label linked with it, and the smallest id reachable."""
    ship(rows.sparkSession)
    given = F.col(vector) if dict(rows.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), given.alias("vector"), F.col(label).alias("label"))
    kept = kept.withColumn("fits", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    fits = kept.where("fits")
    classes = fits.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut_lineage(classes.withColumn("name", F.xxhash64("label", "vector", "vec_id")))
    axes = principal_axes(classes)
    label_type = classes.schema["label"].dataType.simpleString()
    vector_type = classes.schema["vector"].dataType.simpleString()

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros(batch.num_rows)
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                units = unit_vectors(_matrix(batch.take(pa.array(at))).astype(np.float64))
                lead[at] = units @ axes[size][:, 0] if size in axes else units[:, 0]
            yield batch.append_column("size", pa.array(sizes, pa.int32())).append_column("lead", pa.array(lead))

    columns = f"label {label_type}, vector {vector_type}, vec_id bigint, copies bigint, name bigint"
    leading = classes.mapInArrow(led, f"{columns}, size int, lead double")
    ordered = leading.repartitionByRange("label", "size", "lead", "name").sortWithinPartitions("label", "size", "lead", "name")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in batches:
            labels, sizes = batch.column("label"), batch.column("size").to_numpy()
            codes = labels.dictionary_encode().indices.to_numpy() if len(labels) else np.zeros(0)
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                most = max(1, min(TILE, TILE_BYTES // (8 * int(sizes[s])))) if e > s else TILE
                while s < e:
                    if held and (held[0].column("label")[0] != labels[s] or held[0].column("size")[0].as_py() != sizes[s] or sum(h.num_rows for h in held) >= most):
                        yield tile(held, number)
                        held, number = [], number + 1
                    upto = min(e, s + most - sum(h.num_rows for h in held))
                    held.append(batch.slice(s, upto - s))
                    s = upto
        if held:
            yield tile(held, number)
        give_back()

    def tile(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        lead = table["lead"].to_numpy()
        body = table_bytes(table.select(["vec_id", "vector", "copies", "name"]))
        names = ["label", "size", "tile", "low", "high", "body"]
        return pa.RecordBatch.from_arrays([table["label"].combine_chunks()[:1], table["size"].combine_chunks()[:1], pa.array([number]), pa.array([lead.min()]), pa.array([lead.max()]), pa.array([body], pa.binary())], names)

    tiles = cut_lineage(ordered.mapInArrow(tiled, f"label {label_type}, size int, tile bigint, low double, high double, body binary"))
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + DOUBT
    width = max(gap, 1e-6)
    # A tile stands in all cells that it touches; the other side also in those within the gap above it.
    cell = lambda name: F.floor(F.col(name) / width)
    left = tiles.select("label", "size", F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell("low"), F.floor((F.col("high") + gap) / width))).alias("cell"))
    right = tiles.select("label", "size", F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    near = left.join(right, ["label", "size", "cell"]).where((F.col("a") <= F.col("b")) & (F.col("low_b") <= F.col("high_a") + gap) & (F.col("low_a") <= F.col("high_b") + gap))
    near = near.select("a", "b").distinct()
    sides = near.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("tile"))
    bodies = sides.join(tiles.select("tile", "body"), "tile")

    def compared(table: pa.Table) -> pa.Table:
        order = np.argsort(table["tile"].to_numpy(), kind="stable")
        held = [table_of(table["body"][int(i)].as_py()) for i in order]
        parts = [Side(t, axes) for t in held]
        same = len(parts) == 1
        a, b = parts[0], parts[-1]
        links_a, links_b, root = tile_links(a, b, same, threshold)
        links = links_a if same else np.concatenate([links_a, links_b])
        ids = a.names if same else np.concatenate([a.names, b.names])
        names = np.concatenate([t["name"].to_numpy() for t in held])
        some = np.flatnonzero(links)
        return pa.table({"name": names[some], "vec_id": ids[some], "links": links[some], "joined": ids[root[some]]})

    found = bodies.groupBy("a", "b").applyInArrow(compared, "name bigint, vec_id bigint, links bigint, joined bigint")
    found = cut_lineage(found)
    edges = found.select(F.col("vec_id").alias("a"), F.col("joined").alias("b"))
    # Copies of a vector under other ids hang on the smallest of them.
    twins = fits.select("vec_id", "label", "vector")
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "name", "left").select("label", "vector", F.col("vec_id").alias("least"), (F.coalesce("links", F.lit(0).cast("bigint")) + F.col("copies") - 1).alias("n_links"))
    rows_linked = cut_lineage(lookup_join(twins, classes, ["label", "vector"]).select("vec_id", "least", "n_links"))
    edges = edges.unionAll(rows_linked.where("vec_id <> least").select("vec_id", "least"))
    parts = connected_components(edges)
    linked_rows = rows_linked.join(parts, rows_linked["vec_id"] == parts["node"], "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    rest = kept.where("not fits").select("vec_id")
    # An id may have other vectors that do link.
    rest = rest.join(parts, rest["vec_id"] == parts["node"], "left").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return linked_rows.unionAll(rest)
