"""Benchmark passages in training documents by a distributed positional inverted index.

The index is a table with one row per block of whole documents: the block's distinct term hashes in order, the postings
(word positions within the block) of each term one list after another, the documents' ids and their first positions. It
holds the postings of every word of every document and is written once. A search takes a batch of phrases to every block:
a phrase whose rarest term is missing is dropped; for the others, the positions of the rarest term, moved back by its
offset in the phrase, are intersected with the lists of the other terms, rarest first, each moved by its own offset. What is
left are exact occurrences. With ``slack`` above 0 a term may stand up to that many words from its place, which gives
proximity matches.

How it scales: blocks are built where the text is read; building and searching need no shuffle, and a block's documents
are whole, so matches and hit words are complete within it. Memory follows the block, not the partition. Phrases are the
stated query set: they go to the blocks in batches of at most ``BATCH_BYTES`` of text, each collected and sent with the
task, so its size is bounded however large the query table is; one pass over the index serves one batch. Terms are 64-bit
hashes of lower-cased words: a wrong match would need an equal hash (one in 2^64) for every word that differs.
Documents stand ``GAP`` positions apart, so no phrase and no slack reaches from one into the next.

Defined results: null and empty texts have no words; an item of fewer words than a window is one window, one without words
is never found; null item ids are left out of the item list; rows with one item id count as one item; repeated documents
repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, ship, without_ids
from tidemark.llm.packed import ALNUM, CHUNK, chunks, ragged, text_buffer, word_hashes

BATCH_BYTES = 4 << 20
#: Positions between two documents of a block; phrases and slack together are shorter.
GAP = 1024
INDEX_SCHEMA = "block bigint, docs binary, first binary, terms binary, ends binary, postings binary"


class Block:
    """Postings of a block of documents."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, postings: np.ndarray) -> None:
        self.terms, self.postings = terms, postings
        self.starts, self.sizes = np.append(0, ends[:-1]).astype(np.int64)[: len(ends)], np.diff(ends, prepend=0).astype(np.int64)

    @classmethod
    def of_words(cls, hashes: np.ndarray, positions: np.ndarray) -> Block:
        order = np.argsort(hashes, kind="stable")
        ordered, order = hashes[order], positions[order].astype(np.uint32)
        last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.zeros(0, np.int64)
        return cls(ordered[last], (last + 1).astype(np.uint32), order)

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term among the block's terms, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and start positions of all matches; ``phrases`` is (phrase, place) padded to the longest.

        All phrases advance together: round k intersects every phrase's candidates with the list of its k-th rarest term.
        """
        width = phrases.shape[1]
        used = np.arange(width)[None, :] < lengths[:, None]
        slots = self.slots(phrases)
        alive = np.flatnonzero((~used | (slots >= 0)).all(axis=1) & (lengths > 0))
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots, used = slots[alive], used[alive]
        rarity = np.where(used, self.sizes[slots], np.iinfo(np.int64).max)
        places = np.argsort(rarity, axis=1, kind="stable")
        seed = slots[np.arange(len(alive)), places[:, 0]]
        owner = np.repeat(np.arange(len(alive)), self.sizes[seed])
        at = self.postings[ragged(self.starts[seed], self.sizes[seed])].astype(np.int64) - places[owner, 0]
        for k in range(1, width):
            asks = np.flatnonzero(lengths[alive][owner] > k)
            if not len(asks):
                break
            place = places[owner[asks], k]
            found = self.near(slots[owner[asks], place], at[asks] + place, slack)
            gone = np.zeros(len(owner), bool)
            gone[asks[~found]] = True
            owner, at = owner[~gone], at[~gone]
        return alive[owner], at

    def near(self, slot: np.ndarray, position: np.ndarray, slack: int) -> np.ndarray:
        """Whether the list in ``slot`` has a posting within ``slack`` of ``position``: halving in all lists at once."""
        low, high = self.starts[slot].copy(), self.starts[slot] + self.sizes[slot]
        end = high.copy()
        for _ in range(int(self.sizes[slot].max()).bit_length()):
            middle = (low + high) >> 1
            less = (self.postings[np.minimum(middle, len(self.postings) - 1)].astype(np.int64) < position - slack) & (low < high)
            low = np.where(less, middle + 1, low)
            high = np.where(less, high, middle)
        value = self.postings[np.minimum(low, len(self.postings) - 1)].astype(np.int64)
        return (low < end) & (value <= position + slack)


def build_index(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", block_bytes: int = CHUNK) -> DataFrame:
    """The positional index of all documents, written once to the shared folder: one row per block."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, table in enumerate(chunks(batches, limit=block_bytes)):
            hashes, owner = word_hashes(*text_buffer(table["text"]), ALNUM)
            block = Block.of_words(hashes, np.arange(len(hashes)) + owner * GAP)
            ids = pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks()], ["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            documents = np.arange(table.num_rows + 1)
            first = (np.searchsorted(owner, documents) + documents * GAP).astype(np.uint32)
            row = [sink.getvalue().to_pybytes(), first.tobytes(), block.terms.tobytes(), (block.starts + block.sizes).astype(np.uint32).tobytes(), block.postings.tobytes()]
            columns = [pa.array([task + number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "docs", "first", "terms", "ends", "postings"])

    return cut_lineage(narrow.mapInArrow(indexed, INDEX_SCHEMA))


def windows_of(items: list[tuple[str | None, str | None]], size: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Distinct windows (padded), their lengths, and the item numbers that hold each."""
    hashes, owner = word_hashes(*text_buffer(pa.array([t for _, t in items], pa.large_string())), ALNUM)
    bounds = np.searchsorted(owner, np.arange(len(items) + 1))
    held: dict[bytes, list[int]] = {}
    for k, (a, b) in enumerate(itertools.pairwise(bounds)):
        for s in range(a, max(a + 1, b - size + 1)) if b > a else ():
            mine = held.setdefault(hashes[s : min(s + size, b)].tobytes(), [])
            if not mine or mine[-1] != k:
                mine.append(k)
    lengths = np.array([len(w) // 8 for w in held], np.int64)
    padded = np.zeros((len(held), size), np.uint64)
    for k, w in enumerate(held):
        padded[k, : lengths[k]] = np.frombuffer(w, np.uint64)
    return padded, lengths, list(held.values())


def _batches(items: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The query set in batches of bounded bytes, read partition by partition; equal items once."""
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for row in items.distinct().toLocalIterator():
        held.append((row[0], row[1]))
        size += 64 + 4 * len(row[1] or "")
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searcher(batch: list[tuple[str | None, str | None]], window: int, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    phrases, lengths, holders = windows_of(batch, window)
    names = [i for i, _ in batch]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                first = np.frombuffer(row["first"], np.uint32).astype(np.int64)
                n_words = np.diff(first) - GAP
                block = Block(*(np.frombuffer(row[c], kind) for c, kind in (("terms", np.uint64), ("ends", np.uint32), ("postings", np.uint32))))
                phrase, at = block.occurrences(phrases, lengths, slack)
                document = np.searchsorted(first, at + slack, "right") - 1
                hit = np.unique(ragged(at, lengths[phrase]))
                of_hit = np.searchsorted(first, hit + slack, "right") - 1
                inside = (hit >= first[of_hit]) & (hit < (first[:-1] + n_words)[of_hit])  # a term's place may overhang by the slack
                hit, of_hit = hit[inside], of_hit[inside]
                named: list[set[str]] = [set() for _ in n_words]
                for d, p in set(zip(document.tolist(), phrase.tolist(), strict=True)):
                    named[d].update(names[i] for i in holders[p] if names[i] is not None)
                ends = np.searchsorted(of_hit, np.arange(len(first)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array(np.full(len(n_words), row["block"])),
                        "place": pa.array(np.arange(len(n_words), dtype=np.int32)),
                        "doc_id": pa.ipc.open_stream(row["docs"]).read_all()["doc_id"].combine_chunks(),
                        "n_words": pa.array(n_words),
                        "hits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hit - first[of_hit], pa.int32())),
                        "items": pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                    }
                )

    return searched


def find_items(index: DataFrame, items: DataFrame, kind: str, *, window: int = 13, slack: int = 0) -> DataFrame:
    """``doc_id, n_words, hits, items`` of every document: word positions inside a match, ids of the items found, in order.

    ``items`` has two columns, the item id as text and its text; ``kind`` is the SQL type of the document ids.
    """
    if window + 2 * slack >= GAP:
        raise ValueError("window and slack reach beyond the gap between documents")
    ship(index.sparkSession)
    schema = f"block bigint, place int, doc_id {kind}, n_words bigint, hits array<int>, items array<string>"
    found = [index.mapInArrow(_searcher(batch, window, slack), schema) for batch in _batches(items)]
    if not found:
        found = [index.mapInArrow(_searcher([], window, slack), schema)]
    if len(found) == 1:
        return found[0].drop("block", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")]
    return every.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *merged).drop("block", "place")


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """``doc_id, n_words, hits, items`` of every document of ``docs`` against the windows of ``items``."""
    index = build_index(docs, text=text, doc_id=doc_id)
    asked = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    return find_items(index, asked, docs.select(doc_id).schema[0].dataType.simpleString(), window=window)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more lie in benchmark passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 13) -> DataFrame:
    """The rows of ``docs``, as they are, that are not contaminated; rows are told apart by id and text."""
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    named = docs.select(key.alias("key"), F.col(text).alias("text"))
    found = contamination(named, items, doc_id="key", window=window)
    bad = found.where(is_contaminated(F.size("hits").cast("long"), F.col("n_words"))).select("doc_id").distinct()
    return without_ids(docs, key, bad)
