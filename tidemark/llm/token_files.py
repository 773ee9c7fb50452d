"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt out by ranges of the document id into parts, a folder each; parts in their order hold ascending ids.
Each file row is one document: ``doc_id``, ``part_start`` (ids of the part's documents before it), ``n_tokens`` and ``ids``.
ORC writes the integers run-length encoded, keeps minimum and maximum per row group and a Bloom filter on ``doc_id``, and its
stripes are read in parallel; a look-up of documents skips parts, stripes and row groups.

How it scales: texts are encoded where they are read, and one shuffle moves the ids, two bytes each and compressed. A task
encodes chunk by chunk; the distinct white-space words of a chunk are encoded once by the library and gathered by numpy
(its normaliser and its pre-token pattern never look across white space, so this equals encoding whole texts), with a
bounded memory of words met before, under 64-bit hashes. Where parts begin is told by a bounded sample of ids; positions across parts come from
one row per part.

Defined results: a null text is empty and holds the end id alone; null document ids come first; rows that share an id
follow one another in the order of their text code; an empty table gives an empty folder of files and no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.packed import BYTE_VALUE_CASE, SPACED, chunks, prefix_hash, ragged, span_hash, text_buffer
from tidemark.llm.packed import words as words_of

MEMORY = 2_000_000
#: Documents looked at, for each file, to find where the files' id ranges begin.
PROBES = 200
FILE_SCHEMA = "part int, doc_id {kind}, part_start bigint, n_tokens bigint, ids array<int>"
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of white-space words by the tokenizers library, kept in flat arrays under the words' 64-bit hashes.

    Many words go to the library as one text. A word of letters is one pre-token, and every pre-token's last id is one that
    ends a word, so in a text of such words these ids tell the words apart (their number is compared). Between other words
    stands a lone control character, whose id no other text gives.
    """

    BETWEEN = "\x01"

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        alone = self.tokenizer.encode(f"a {self.BETWEEN} a", add_special_tokens=False).ids
        self.between = alone[1] if len(alone) == 3 else None
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.apart = [self.BETWEEN, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.clear()

    @classmethod
    def of(cls, vocabulary: str) -> WordEncoder:
        """The worker's encoder, which it keeps from task to task."""
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def clear(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words, whose hashes are in order."""
        apart = self.apart
        odd = [k for k, w in enumerate(words) if self.between is None or any(a in w for a in apart)]
        rest = sorted(set(range(len(words))).difference(odd)) if odd else range(len(words))
        lettered = [k for k in rest if words[k].isalpha()] if self.final.any() else []
        mixed = [k for k in rest if not words[k].isalpha()] if lettered else list(rest)
        order, flat, lengths = [], [], []
        for some in (lettered[k : k + 4000] for k in range(0, len(lettered), 4000)):
            ids = np.array(self.tokenizer.encode(" ".join([words[k] for k in some]), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.final[ids])
            if len(ends) != len(some):
                mixed += some
                continue
            order += some
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=-1))
        for some in (mixed[k : k + 4000] for k in range(0, len(mixed), 4000)):
            ids = np.array(self.tokenizer.encode(f" {self.BETWEEN} ".join([words[k] for k in some]), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(ids == self.between)
            order += some
            flat.append(np.delete(ids, ends))
            lengths.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
        for e in self.tokenizer.encode_batch([words[k] for k in odd], add_special_tokens=False):
            flat.append(np.array(e.ids, np.int32))
            lengths.append(np.array([len(e.ids)], np.int64))
        order += odd
        slots = np.empty(len(words), np.int64)
        slots[order] = len(self.lengths) + np.arange(len(words))
        sizes = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.lengths = np.concatenate([self.flat, *flat]), np.concatenate([self.lengths, sizes])
        at = np.searchsorted(self.known, hashes)
        self.known, self.slots = np.insert(self.known, at, hashes), np.insert(self.slots, at, slots)

    def encode(self, column: pa.ChunkedArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the n+1 offsets of the texts."""
        data, offsets = text_buffer(column)
        starts, ends, owner = words_of(data, offsets, SPACED)
        distinct, first, where = np.unique(span_hash(prefix_hash(data, BYTE_VALUE_CASE), starts, ends), return_index=True, return_inverse=True)
        fresh = self._unknown(distinct)
        if len(self.known) + len(fresh) > MEMORY:
            self.clear()
            fresh = np.arange(len(distinct))
        if len(fresh):
            self.add(distinct[fresh], [data[starts[k] : ends[k]].tobytes().decode() for k in first[fresh].tolist()])
        slots = self.slots[np.searchsorted(self.known, distinct)] if len(distinct) else np.zeros(0, np.int64)
        # One more word, the end id, behind the words of each text.
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        lengths, begins, flat = np.append(self.lengths, 1), np.append(self.starts, len(self.flat)), np.append(self.flat, np.int32(end_id))
        order = np.insert(slots[where], bounds[1:], len(lengths) - 1)
        size = lengths[order]
        upto = np.concatenate([[0], np.cumsum(size)])
        return flat[ragged(begins[order], size)], upto[bounds + np.arange(len(bounds))]

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.arange(len(hashes))
        return np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes)


def id_ranges(docs: DataFrame, files: int) -> list:
    """Ids at which the files after the first begin, from a bounded sample of ids."""
    count = docs.count()
    share = min(1.0, 1.2 * PROBES * files / max(1, count))
    chosen = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit("range"), "doc_id"), F.lit(1 << 30)) <= share * (1 << 30)))
    ids = sorted(r[0] for r in chosen.select("doc_id").limit(2 * PROBES * files).collect())
    return sorted({ids[len(ids) * k // files] for k in range(1, files)}) if ids else []


def write_token_files(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", files: int | None = None, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Write the ids of all documents under ``path``: one folder for each part, parts in ascending document ids."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    files = files or max(spark.sparkContext.defaultParallelism, narrow.rdd.getNumPartitions())
    kind = narrow.schema["doc_id"].dataType.simpleString()
    begins = id_ranges(narrow, files)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = WordEncoder.of(vocabulary), zstandard.ZstdCompressor(level=1)
        for table in chunks(batches):
            ids, ends = encoder.encode(table["text"], end_id)
            small = ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids
            bodies = [squeeze.compress(small[a:b].tobytes()) for a, b in itertools.pairwise(ends)]
            part = [0 if d is None else bisect_right(begins, d) for d in table["doc_id"].to_pylist()]
            codes = [zlib.crc32(b) for b in bodies]
            columns = {"part": pa.array(part, pa.int32()), "doc_id": table["doc_id"], "code": pa.array(codes, pa.int64()), "n_tokens": pa.array(np.diff(ends)), "body": pa.array(bodies, pa.binary())}
            yield from pa.table(columns).to_batches()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, starts = zstandard.ZstdDecompressor(), {}
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                n = batch.column("n_tokens").to_numpy()
                raw = [expand.decompress(b) for b in batch.column("body").to_pylist()]
                ids = [np.frombuffer(b, np.uint16 if len(b) == 2 * c else np.int32).astype(np.int32) for b, c in zip(raw, n.tolist(), strict=True)]
                begin = []
                for part, c in zip(batch.column("part").to_pylist(), n.tolist(), strict=True):
                    begin.append(starts.get(part, 0))
                    starts[part] = begin[-1] + c
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "doc_id": batch.column("doc_id"), "part_start": pa.array(begin, pa.int64()), "n_tokens": pa.array(n), "ids": lists})

    rows = narrow.mapInArrow(encoded, f"part int, doc_id {kind}, code bigint, n_tokens bigint, body binary")
    ordered = rows.repartition(files, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "code")
    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ordered.mapInArrow(opened, FILE_SCHEMA.format(kind=kind)).write.options(**options).partitionBy("part").orc(path)


def stored_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of the files; filters on ``doc_id`` prune stripes and row groups, filters on ``part`` folders."""
    return spark.read.schema(FILE_SCHEMA.format(kind=kind)).orc(path)


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` of parts with ``start``, the ids of all documents before: the part's own, and those of earlier parts."""
    per_part = stored.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select(F.col("part").alias("_part"), F.coalesce(F.sum("_ids").over(ahead), F.lit(0)).alias("_base"))
    joined = rows.join(base, rows["part"] == base["_part"])
    return joined.withColumn("start", F.col("_base") + F.col("part_start")).drop("part", "part_start", "_part", "_base")


def read_token_files(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, n_tokens, ids, start`` of all documents; ``kind`` is the type of the document ids."""
    stored = stored_rows(spark, path, kind)
    return with_start(stored, stored)


def token_digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents; counts and codes come from the ids read back."""
    ship(spark)
    stored = stored_rows(spark, path, kind)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            codes = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "doc_id": batch.column("doc_id"), "part_start": batch.column("part_start"), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(codes, pa.int64())})

    narrow = stored.select("part", "doc_id", "part_start", "ids").mapInArrow(digested, f"part int, doc_id {kind}, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return with_start(narrow, stored).select("doc_id", "start", "n_tokens", "ids_crc32")
