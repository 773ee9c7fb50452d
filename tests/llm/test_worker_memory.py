"""Memory of executors: buffers of Python workers, and of the tables written between steps."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import langid, minhash, packed
from tidemark.llm.common import cut_lineage


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_cut_tables_use_a_codec_whose_buffers_lie_on_the_heap(spark):
    held = cut_lineage(spark.range(5).selectExpr("id", "cast(id AS string) AS text"))
    assert all(f.endswith(".zstd.parquet") for f in held.inputFiles())
    assert sorted(map(tuple, held.collect())) == [(k, str(k)) for k in range(5)]


def test_windows_of_many_words_take_little_beside_themselves():
    words = pa.array([f"w{k:09d}" for k in range(100_000)] + ["", "x" * 100], pa.large_string())
    assert peak_mb(lambda: langid.windows(words)) < 25
    symbols, lengths, owner = langid.windows(words)
    assert bytes(symbols[99_999]).rstrip() == b" w000099999" and lengths[99_999] == 12
    assert list(owner[-4:]) == [100_000, 100_001, 100_001, 100_001] and list(lengths[-4:]) == [2, 48, 48, 10]


def test_hashes_go_on_beyond_a_tile():
    data = np.frombuffer(b"some words of a text " * 10_000, np.uint8)
    assert len(data) > 3 * packed.TILE
    up = packed._powers(len(data) + 1)[0]
    assert (packed.prefix_hash(data)[1:] == np.cumsum(packed.BYTE_VALUE[data] * up[: len(data)])).all()
    assert (packed.looked_up(packed.SPACED, data) == packed.SPACED[data]).all()
    assert peak_mb(lambda: packed.prefix_hash(data)) < 16 * len(data) / 1e6 + 2


def test_signatures_hold_a_bounded_part_of_a_batch():
    text = " ".join(f"w{k}" for k in range(20_000))
    described, _ = minhash._described(5, "bigint")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(20), pa.int64()), "text": pa.array([text] * 20)})
    packed._powers(2 << 20)
    assert peak_mb(lambda: list(described(iter([batch])))) < 28
