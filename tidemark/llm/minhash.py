"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation scatters the set, a second one, shifted
by 1, 2, ... places around its circle, gives all ``BANDS * ROWS`` signature coordinates. Documents whose coordinates agree
in a band meet in a bucket.

Equal sets form one class, represented by its smallest id. A bucket's head is its member with the most company in all its
buckets; among near copies of one text that is the text itself or the copy nearest to it. In round one every class is
compared with one head of its buckets. What those links join needs no comparison among itself. In round two, only in buckets
that still hold several components, every member outside the head's component is compared with the members of the other
components. Pairs are compared in the join itself, before they become rows, by set size, by two bits of every coordinate,
and by a parity sketch: a bitmap in which every shingle flips one bit. Two sketches differ in no more bits than the sets
in elements, so for sets whose every shingle is in the sketch this test never drops a link, and it leaves hardly a pair
that is none. All pairs that pass are verified on their full sets. Every pair that shares a bucket is thus joined already
or compared: no link of a bucket is lost, and a bucket of copies never lists its pairs.

Chances, for a pair at the threshold of 0.8: to share no band (1 - 0.8^4)^32 = 5e-8; to agree in fewer than ``AGREE`` of
the 128 coordinates by two bits, or, for sets beyond ``SKETCHED`` shingles (of which the sketch takes a quarter, a sixteenth,
...), to differ by six standard deviations, about 1e-9. More similar pairs have less.

How it scales: texts are read once for sets and signatures, and once more in each round for the documents in pairs (a
bounded bitmap of their ids keeps most others from being moved). Shuffled are 32 small
rows for each class, and the texts of pairs. No bucket, class or component is collected anywhere.

Defined results: documents without words are linked with nothing; fewer words than a shingle make one shingle; null ids are
linked with nothing; repeated rows are in one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, ship, unused, with_maybe, without_ids
from tidemark.llm.components import connected_components
from tidemark.llm.packed import SPACED, chunks, mix, ragged, text_buffer, word_hashes
from tidemark.operators.slices import lookup_join

BANDS, ROWS = 32, 4
AGREE = 84
#: Bits of the parity sketch, and the set size up to which every shingle is in it.
PARITY, SKETCHED = 2048, 1536
#: Shingles handled at once while signatures are made, so that the arrays stay in a core's cache.
TILE = 1 << 15
#: Bytes of text whose shingles a worker holds at once: about twenty-five times as many bytes of hashes.
CHUNK = 1 << 20
#: Pairs of one class that are verified together.
TOGETHER = 256


def shingle_sets(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text by text and sorted, and the n+1 offsets of the texts."""
    hashes, owner = word_hashes(*text_buffer(column), SPACED)
    n = len(column)
    counts = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    used = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = ragged(first[:-1], used)
    of = np.repeat(np.arange(n), used)
    length = np.minimum(counts[of], size)
    value = np.zeros(len(start), np.uint64)
    for k in range(size):
        with_word = k < length
        word = hashes[np.minimum(start + k, max(0, len(hashes) - 1))] if len(hashes) else value
        value = np.where(with_word, mix(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(n + 1))


def circle(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit circle; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(coordinate, set) minima over every set; empty sets have no defined column."""
    n = len(offsets) - 1
    out = np.full((BANDS * ROWS, n), np.uint32(0xFFFFFFFF), np.uint32)
    if not len(values):
        return out
    scattered = (mix(values) >> np.uint64(32)).astype(np.uint32)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts, ends = offsets[filled], offsets[filled + 1]
    a = 0
    while a < len(filled):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + TILE, "right")))
        for low in range(starts[a], ends[b - 1], TILE * 8):  # one long set in parts
            high = min(low + TILE * 8, ends[b - 1])
            tile = scattered[low:high]
            cuts = np.maximum(starts[a:b], low) - low if b - a > 1 else np.zeros(1, np.int64)
            for k in range(BANDS * ROWS):
                found = np.minimum.reduceat(circle(tile - np.uint32(k + 1)), cuts)
                spot = out[k]
                spot[filled[a:b]] = np.minimum(spot[filled[a:b]], found)
        a = b
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """(set, band) keys."""
    keys = np.zeros((BANDS, signature.shape[1]), np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[k::ROWS].astype(np.uint64) + np.uint64(1))
    return keys.T


def _two_bits(signature: np.ndarray) -> np.ndarray:
    """(set, 4) longs: the lowest bit of all coordinates, then the next bit."""
    bits = [np.packbits(((signature >> np.uint32(b)) & np.uint32(1)).astype(np.uint8).T, axis=1) for b in (0, 1)]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.int64)


def _thinning(n: np.ndarray) -> np.ndarray:
    """Powers of four by which the sketch of a set of that size thins its shingles."""
    return np.ceil(np.log2(np.maximum(1.0, n / SKETCHED)) / 2).astype(np.int64)


def parity_sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(set, PARITY / 64) longs in which every shingle that is taken flips one bit."""
    n, step = len(offsets) - 1, 512
    thin = _thinning(np.diff(offsets))
    out = np.zeros((n, PARITY // 64), np.int64)
    for a in range(0, n, step):
        b = min(n, a + step)
        mine = values[offsets[a] : offsets[b]]
        owner = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        spread = mix(mine + np.uint64(3))
        taken = (spread >> np.uint64(20) & ((np.uint64(1) << (2 * thin[a:b][owner]).astype(np.uint64)) - np.uint64(1))) == 0
        bit = (spread[taken] % np.uint64(PARITY)).astype(np.int64)
        flips = np.bincount(owner[taken] * PARITY + bit, minlength=(b - a) * PARITY)
        out[a:b] = np.packbits((flips & 1).astype(np.uint8).reshape(b - a, PARITY), axis=1).view(np.int64)
    return out


def _described(size: int, kind: str):  # noqa: ANN202
    schema = f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, bits array<bigint>, bands array<bigint>"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, limit=CHUNK):
            values, offsets = shingle_sets(table["text"], size)
            n = len(offsets) - 1
            f1, f2 = (_fingerprints(values, offsets, salt) for salt in (1, 2))
            signature = signatures(values, offsets)
            bands = _band_keys(signature).astype(np.int64)
            bits = np.concatenate([_two_bits(signature), parity_sketches(values, offsets)], axis=1)
            columns = {
                "doc_id": table["doc_id"],
                "n": pa.array(np.diff(offsets)),
                "f1": pa.array(f1),
                "f2": pa.array(f2),
                "bits": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1))),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(np.ascontiguousarray(bands).reshape(-1))),
            }
            yield from pa.table(columns).to_batches()

    return described, schema


def _may_link(percent: int) -> Column:
    """Whether two classes (columns ``l_n, l_bits, r_n, r_bits``) may reach the threshold."""
    a, b = (lambda k: F.col("l_bits")[k]), (lambda k: F.col("r_bits")[k])
    least, most, both = F.least("l_n", "r_n"), F.greatest("l_n", "r_n"), F.col("l_n") + F.col("r_n")
    signature = F.bit_count(a(0).bitwiseXOR(b(0)).bitwiseOR(a(2).bitwiseXOR(b(2)))) + F.bit_count(a(1).bitwiseXOR(b(1)).bitwiseOR(a(3).bitwiseXOR(b(3))))
    flipped = reduce(add, [F.bit_count(a(k).bitwiseXOR(b(k))) for k in range(4, 4 + PARITY // 64)])
    # Sets of n shingles together that reach the threshold differ in n * (100 - percent) / (100 + percent) at most.
    allowed = both * (100 - percent) / (100 + percent)
    thin = [F.ceil(F.log2(F.greatest(F.lit(1.0), F.col(c) / float(SKETCHED))) / 2) for c in ("l_n", "r_n")]
    part = allowed / F.pow(F.lit(4.0), thin[0])
    sketch = (thin[0] != thin[1]) | (flipped <= F.when(thin[0] == 0, allowed).otherwise(part + 6 * F.sqrt(part) + 6))
    return (least * 100 >= most * percent) & (signature <= BANDS * ROWS - AGREE) & sketch


def _fingerprints(values: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Sum of a mix of every shingle of each set; two such sums stand for the whole set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)))])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def _texts(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """``name, text`` of the classes in ``asked(name)``: a class is named by its least id and the fingerprint of its set."""
    ids = cut_lineage(asked.select("name.id").distinct())
    held = with_maybe(docs, F.col("doc_id"), ids, "maybe").where("maybe").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, limit=CHUNK):
            f = _fingerprints(*shingle_sets(table["text"], size), 1)
            yield from pa.table({"id": table["doc_id"], "f": pa.array(f), "text": table["text"]}).to_batches()

    held = held.select("doc_id", "text").mapInArrow(named, f"id {kind}, f bigint, text string")
    held = held.groupBy("id", "f").agg(F.first("text").alias("text"))
    return asked.join(held.select(F.struct("id", "f").alias("name"), "text"), "name")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of class names whose full sets reach the threshold.

    A class in many pairs has its text copied for every ``TOGETHER`` of them, so that no task gets all pairs of one head.
    """
    counts = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.select("name", F.ceil(F.col("n") / TOGETHER).alias("salts")))
    texts = cut_lineage(_texts(docs, counts, size))
    rows = pairs
    for side, other in (("a", "b"), ("b", "a")):
        rows = lookup_join(rows, counts.select(F.col("name").alias(side), "salts"), side)
        rows = rows.withColumn(f"{side}_salt", F.pmod(F.xxhash64(other), "salts")).drop("salts")
    for side in ("a", "b"):
        held = texts.select(F.col("name").alias(side), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias(f"{side}_salt"), F.col("text").alias(f"t{side}"))
        rows = rows.join(held, [side, f"{side}_salt"])
    kind = pairs.schema["a"].dataType.simpleString()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in chunks(iter([batch]), text="ta", limit=CHUNK):
                (va, oa), (vb, ob) = (shingle_sets(table[c], size) for c in ("ta", "tb"))
                n = table.num_rows
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))])
                value = np.concatenate([va, vb])
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                twice = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
                both = np.bincount(owner[1:][twice], minlength=n)
                union = np.diff(oa) + np.diff(ob) - both
                yield from table.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (both > 0))).to_batches()

    return rows.select("a", "b", "ta", "tb").mapInArrow(checked, f"a {kind}, b {kind}")


def _same_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges from ids on rows with several sets to the names of their classes."""
    again = known.groupBy("doc_id").agg((F.min("f1") != F.max("f1")).alias("several")).where("several").select("doc_id")
    held = known.select("doc_id", "f1", "f2", "n").join(again, "doc_id", "left_semi")
    edges = held.join(classes.select("f1", "f2", "n", "least"), ["f1", "f2", "n"]).where("doc_id <> least")
    return edges.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: links are Jaccard similarities of ``percent`` or more."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    described, schema = _described(size, narrow.schema["doc_id"].dataType.simpleString())
    rows = cut_lineage(narrow.mapInArrow(described, schema))
    known = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    # An id may stand on rows with several texts, so a class is named by its least id and its fingerprint.
    classes = cut_lineage(classes.withColumn("id", F.struct(F.col("least").alias("id"), F.col("f1").alias("f"))))
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    members = cut_lineage(members.join(buckets, ["band", "key"]))
    facts = classes.select("id", "n", "bits")

    def fact(prefix: str) -> DataFrame:
        return facts.select(F.col("id").alias(f"{prefix}id"), F.col("n").alias(f"{prefix}n"), F.col("bits").alias(f"{prefix}bits"))

    # Round one: one pair for each class, with the head that has the most company.
    rank = cut_lineage(members.groupBy("id").agg(F.sum("company").alias("rank")))
    members = cut_lineage(members.drop("company").join(rank, "id"))
    heads = members.groupBy("band", "key").agg(F.max(F.struct("rank", "id")).alias("head"))
    members = cut_lineage(members.join(heads, ["band", "key"]).select("band", "key", "id", "head"))
    stars = members.where("id != head.id").select("id", "head").distinct()
    stars = stars.join(fact("l_"), F.col("id") == F.col("l_id")).join(fact("r_"), F.col("head.id") == F.col("r_id")).where(_may_link(percent))
    stars = stars.groupBy("id").agg(F.max("head").alias("head")).select("id", F.col("head.id").alias("head"))
    pairs = cut_lineage(stars.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct())
    links = _verified(pairs, narrow, size, percent).select("a.id", "b.id").toDF("a", "b")
    joined = cut_lineage(connected_components(cut_lineage(links.unionAll(_same_ids(known, classes)))))
    # Round two: in buckets with several components, members outside the head's against the other components.
    placed = members.join(joined, F.col("id.id") == F.col("node"), "left").select("band", "key", "id", F.coalesce("component", "id.id").alias("component"), (F.col("id") == F.col("head.id")).alias("is_head"))
    several = placed.groupBy("band", "key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.max(F.when(F.col("is_head"), F.col("component"))).alias("main"))
    several = cut_lineage(placed.drop("is_head").join(several.where("first < last").drop("first", "last"), ["band", "key"]))
    sides = several.join(fact("l_"), F.col("id") == F.col("l_id")).select("band", "key", "l_id", "l_n", "l_bits", F.col("component").alias("l_component"), (F.col("component") == F.col("main")).alias("in_main"))
    left = sides.where("not in_main").drop("in_main")
    right = sides.select("band", "key", *[F.col(f"l_{c}").alias(f"r_{c}") for c in ("id", "n", "bits", "component")], "in_main")
    crossing = (left["l_component"] != right["r_component"]) & (right["in_main"] | (right["r_id"] < left["l_id"])) & _may_link(percent)
    more = left.join(right, (left["band"] == right["band"]) & (left["key"] == right["key"]) & crossing)
    more = cut_lineage(more.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    late = cut_lineage(_verified(more, narrow, size, percent))
    if late.limit(1).count():
        tree = joined.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        joined = cut_lineage(connected_components(tree.unionAll(late.select("a.id", "b.id"))))
    named = classes.select("f1", "f2", "n", "least").join(joined, F.col("least") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "least").alias("component"))
    out = rows.join(named, ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document represents its component; repeated rows of one id and text stay once."""
    found = cut_lineage(near_duplicates(docs, size=size, percent=percent, text=text, doc_id=doc_id))
    by_id = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    by_id = cut_lineage(by_id.where("not stays or rows > 1").select("doc_id", "stays"))
    out = without_ids(docs, F.col(doc_id), by_id.where("not stays").select("doc_id"))
    again = by_id.where("stays").select("doc_id")
    if again.limit(1).count():
        flag = unused("_maybe", out)
        marked = with_maybe(out, F.col(doc_id), again, flag)
        out = marked.where(~F.col(flag)).drop(flag).unionAll(marked.where(flag).drop(flag).dropDuplicates([doc_id, text]))
    return out
