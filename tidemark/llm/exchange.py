"""Questions and answers between blocks of documents and shards of a hashed key space, as packed arrays.

A block is a chunk of whole documents of one input task; a shard owns a range of hash values. A block sends each shard one
message with the distinct values it needs; the shard merges the messages of all blocks and answers each block in the order
that it asked in; the block meets its answers again beside its own texts. What is shuffled are compressed arrays, one for
each block and shard that have something to say to each other, and the compressed texts once.

A block is made again from the input when it is asked for a second time. Rows that come from files come again in the same
order; ``steady`` writes rows that come out of a shuffle first. A block is named by its place and its content, so texts that
did change between two passes are noticed: their answers belong to no block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import ship
from tidemark.llm.packed import chunks, give_back, text_buffer
from tidemark.session import cut_lineage

BLOCK_BYTES = 4 << 20
#: Answers of a shard that are handed on together.
ANSWER_BYTES = 1 << 20
MESSAGE = "block bigint, shard int, body binary"
Message = tuple[int, bytes]


def slim(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned form of non-negative whole numbers."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; wide types are stored byte plane by byte plane, which compresses better."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<cBq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 1
    for _ in range(data[0]):
        kind, width, n = struct.unpack_from("<cBq", data, at)
        at += 10
        raw = np.frombuffer(data, np.uint8, n * width, at)
        at += n * width
        dtype = np.dtype(f"{kind.decode()}{width}") if width > 1 else np.dtype(np.int8 if kind == b"i" else np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).reshape(n) if width > 1 else raw.view(dtype))
    return out


def joined(parts: list[np.ndarray], kind: type | np.dtype) -> np.ndarray:
    """Parts one after another, empty or not, as one type."""
    return np.concatenate([np.zeros(0, kind), *(p.astype(kind, copy=False) for p in parts)])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of an input task, each with a non-negative name."""
    task = TaskContext.get().partitionId() << 24
    for number, table in enumerate(chunks(batches, limit=BLOCK_BYTES)):
        data, offsets = text_buffer(table["text"])
        name = xxhash.xxh64(offsets.tobytes(), seed=task + number)
        name.update(data)
        yield name.intdigest() >> 1, table


def steady(df: DataFrame) -> DataFrame:
    """Rows that come again in the same order: ``df`` itself, or written to files if they come out of a shuffle."""
    return cut_lineage(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def message_rows(blocks: list[int], shards: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(shards, pa.int32()), pa.array(bodies, pa.binary())], ["block", "shard", "body"])


def questions(docs: DataFrame, ask: Callable[[pa.Table], Iterator[Message]]) -> DataFrame:
    """``block, shard, body`` messages that ``ask`` makes of every block."""
    ship(docs.sparkSession)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches):
            for shard, body in ask(table):
                yield message_rows([block], [shard], [body])

    return docs.mapInArrow(asked, MESSAGE)


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def table_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def texts_of(docs: DataFrame) -> DataFrame:
    """``block, shard, body``: every block's rows in compressed form, as shard -1."""
    ship(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches):
            yield message_rows([block], [-1], [table_bytes(table)])

    return docs.mapInArrow(packed, MESSAGE)


def by_shard(messages: DataFrame, work: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``block, shard, body``: what ``work(shard, blocks, bodies)`` answers, one or no message for a block.

    Answers are handed on while ``work`` goes on making others.
    """

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        shard = table["shard"][0].as_py()
        table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
        blocks, bodies = table["block"].to_pylist(), table["body"].to_pylist()
        del table
        held: list[tuple[int, bytes]] = []
        size = 0
        for block, body in work(shard, blocks, bodies):
            held.append((block, body))
            size += len(body)
            if size >= ANSWER_BYTES:
                yield message_rows([b for b, _ in held], [shard] * len(held), [x for _, x in held])
                held, size = [], 0
        yield message_rows([b for b, _ in held], [shard] * len(held), [x for _, x in held])
        give_back()

    return messages.groupBy("shard").applyInArrow(worked, MESSAGE)


def by_block(docs: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Rows that ``work(block, texts, answers by shard)`` makes of every block."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        block = table["block"][0].as_py()
        held = dict(zip(table["shard"].to_pylist(), table["body"].to_pylist(), strict=True))
        del table
        if -1 not in held:
            raise RuntimeError("an input task gave other rows than before; write the input to files first")
        yield from work(block, table_of(held.pop(-1)), held).to_batches()
        give_back()

    return texts_of(docs).unionAll(answers).groupBy("block").applyInArrow(worked, schema)
