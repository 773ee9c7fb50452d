"""Remove passages that earlier documents hold, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``shared_intervals`` is the core: of a set of byte strings it makes the transform, and extends all intervals of suffixes
backward by one byte at a time, breadth first. In step l the borders between suffixes that share exactly l bytes
follow from those of step l - 1 through the transform's byte order alone, so common prefixes appear by increasing value; it
stops at the minimum length, and what is not yet separated shares at least that much.

To bring equal strings together, every window of ``length`` bytes is named by the smallest ``ANCHOR``-byte string in it (its
minimiser): equal windows have equal anchors. Maximal runs of windows with one anchor form a segment. Three passes over the
texts: anchors that more than one document holds are found by hash; their segments go, each distinct one once for a block, to
the shard of the anchor; there the distinct segments are expanded as above and every window gets the smallest document
that holds its bytes; each block then removes the bytes of windows that a smaller document holds.

How it scales: a segment of a passage that a third of all documents share is sent once by a block and expanded once in
its shard. An anchor whose segments may exceed ``CROWDED`` bytes over all blocks (the edge of a line that many documents hold
has another segment in each) gives up its segments: each of their windows becomes a segment of its own and goes to the shard
of its own hash, which equal windows share. Shards are as many as the corpus needs (``SHARD_BYTES`` of text each), and a shard
expands its segments in portions of whole anchors (``PORTION`` bytes, or one anchor's, ``CROWDED`` at most). Messages are compressed arrays (``exchange``).
No text is cut, and no window, anchor or segment is left out.

Defined results: a null text is empty; texts shorter than ``length`` are kept whole; rows with equal ids never remove from
one another; rows with a null id are kept whole and remove nothing; an empty table gives no rows; other columns are not read.
Document ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import MESSAGE, Message, by_block, by_shard, joined, message_rows, pack, questions, slim, steady, unpack
from tidemark.llm.packed import BYTE_VALUE_CASE, inverse_powers, prefix_hash, ragged, span_hash, text_buffer

ANCHOR = 24
SHARD_BYTES = 16 << 20
#: Bytes that are expanded together: with their ranks and intervals they fit in a core's cache.
PORTION = 1 << 18
#: Symbols from which three of their ranks do not fit in 63 bits.
TREBLED = (1 << 21) - 1
#: Bytes of an anchor's segments over all blocks beyond which its windows are dealt out one by one.
CROWDED = 8 << 20
NOBODY = np.iinfo(np.int64).max
KEPT_SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def sorted_suffixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """Suffix starts in the order of their first ``least`` symbols at least.

    Ranks are trebled in reach at a time (doubled where three ranks do not fit in a word); only rows that still tie are sorted again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    known, reach = 7, 3 if n < TREBLED else 2
    while known < least and not fresh.all():
        rank = np.zeros(n + (reach - 1) * known, np.int64)  # 0 beyond the end
        rank[order] = np.cumsum(fresh)
        tied = ~fresh
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        mine = order[at]
        key = rank[mine]
        for k in range(1, reach):
            key *= n + 1
            key += rank[mine + k * known]
        turn = np.argsort(key)
        order[at], key = mine[turn], key[turn]
        fresh[at[1:]] |= key[1:] != key[:-1]
        known *= reach
    return order


def shared_intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and where intervals begin whose suffixes share ``length`` symbols or more.

    ``last`` is the transform: the symbol before each suffix. Rows sorted by it, without change among equal symbols, are
    the suffixes one symbol longer, so ``shorter[k]`` is the row of the suffix k without its first symbol. Two neighbours that
    begin alike differ after l symbols if and only if a border of step l - 1 lies between their shorter rows.
    """
    order = sorted_suffixes(symbols, length)
    last = symbols[order - 1]
    shorter = np.argsort(last, kind="stable")
    first = symbols[order]
    border = np.ones(len(order), bool)
    border[1:] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~border)
    lower, upper = shorter[open_], shorter[open_ - 1]
    for _ in range(length - 1):
        interval = np.cumsum(border, dtype=np.int32)
        apart = interval[lower] != interval[upper]
        border[open_[apart]] = True
        parted = np.count_nonzero(apart)
        if parted == len(open_):
            break
        if 8 * parted > len(open_):  # rows once parted stay so; they are dropped when they are many
            open_, lower, upper = open_[~apart], lower[~apart], upper[~apart]
    return order, border


def smallest_owners(data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` bytes of every string, in order, the smallest owner of a string that holds its bytes."""
    strings = len(lengths)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.zeros(int((lengths + 1).sum()), np.uint16)  # 0 stands between strings
    symbols[ragged(starts, lengths)] = data.astype(np.uint16) + 1
    windows = np.maximum(0, lengths - length + 1)
    at = ragged(starts, windows)
    owner = np.full(len(symbols), NOBODY, np.int64)
    owner[at] = np.repeat(owners, windows) if strings else 0
    order, border = shared_intervals(symbols, length)
    begins = np.flatnonzero(border)
    least = np.minimum.reduceat(owner[order], begins)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(begins, len(order))))
    return out[at]


def sliding(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima within and against blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


class Segments:
    """Runs of windows with one anchor in a block of texts.

    The block is gone through in parts that a core's cache holds; a run that goes on into the next part becomes two
    segments, which changes no window and no anchor.
    """

    PART = 1 << 17

    def __init__(self, table: pa.Table, length: int) -> None:
        self.data, self.offsets = data, offsets = text_buffer(table["text"])
        ids = table["doc_id"].combine_chunks()
        unknown = ids.is_null().to_numpy(zero_copy_only=False)
        #: Document ids; a null id is nobody's.
        self.owners = np.where(unknown, NOBODY, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.length, self.hashes = length, prefix_hash(data, BYTE_VALUE_CASE)
        starts, counts, anchors = [], [], []
        reach = length - ANCHOR
        for a in range(0, len(data) - length + 1, self.PART):
            b = min(len(data) - length + 1, a + self.PART)
            named = self._named(a, b + reach)
            named &= ~np.uint64(0xFFFFFF)
            named |= np.arange(len(named), dtype=np.uint64)  # ties go to the first place
            anchor = (sliding(named, reach + 1) & np.uint64(0xFFFFFF)).astype(np.int32)
            # The first window that reaches beyond its document, for all windows.
            first, last = np.searchsorted(offsets, [a, b - 1], "right") - 1
            ends = offsets[first + 1 : last + 2]
            end = np.repeat(ends, np.diff(np.concatenate([[a], np.minimum(ends, b)])))
            inside = np.arange(a + length, b + length) <= end
            turn = np.ones(b - a + 1, bool)
            turn[1:-1] = (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1]) | (inside[1:] != inside[:-1])
            run = np.flatnonzero(turn)
            begin, count = run[:-1], np.diff(run)
            held = inside[begin]
            begin, count = begin[held], count[held]
            starts.append(a + begin)
            counts.append(count)
            anchors.append(a + anchor[begin].astype(np.int64))
        self.start, self.windows, place = (joined(x, np.int64) for x in (starts, counts, anchors))
        self.size = self.windows + length - 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.anchor = span_hash(self.hashes, place, place + ANCHOR)

    def _named(self, a: int, b: int) -> np.ndarray:
        """Scattered hashes of the ``ANCHOR`` bytes from a, a + 1, ..., b - 1."""
        name = (self.hashes[a + ANCHOR : b + ANCHOR] - self.hashes[a:b]) * inverse_powers(b)[a:b]
        name ^= name >> np.uint64(32)
        name *= np.uint64(0xD6E8FEB86659FD93)
        return name

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, whether several documents hold each, and each segment's anchor's number."""
        order = np.argsort(self.anchor)
        ordered = self.anchor[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first, owner = np.flatnonzero(fresh), self.owners[self.doc][order]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        if not len(first):
            return ordered, fresh, number
        return ordered[first], np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first), number

    def scatter(self, crowded: np.ndarray) -> np.ndarray:
        """Make every window of the crowded anchors a segment named by its own bytes; which segments these are."""
        mine = np.isin(self.anchor, crowded)
        windows = self.windows[mine]
        start = ragged(self.start[mine], windows)
        name = span_hash(self.hashes, start, start + self.length)
        name = (name ^ name >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        name ^= name >> np.uint64(29)
        one = np.ones(len(start), np.int64)
        self.anchor = np.concatenate([self.anchor[~mine], name])
        self.start, self.windows = np.concatenate([self.start[~mine], start]), np.concatenate([self.windows[~mine], one])
        self.size, self.doc = np.concatenate([self.size[~mine], one * self.length]), np.concatenate([self.doc[~mine], np.repeat(self.doc[mine], windows)])
        return mine

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One segment of each kind (anchor and bytes), in the order of anchors; each segment's kind; each kind's smallest owner."""
        content = span_hash(self.hashes, self.start, self.start + self.size)
        order = np.lexsort((content, self.anchor))
        a, c = self.anchor[order], content[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        return order[first], kind, np.minimum.reduceat(self.owners[self.doc][order], first) if len(first) else np.zeros(0, np.int64)


def _shard(anchors: np.ndarray, shards: int) -> np.ndarray:
    return ((anchors >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _contents(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of strings that stand one after another, a portion of them at a time."""
    out, a = np.zeros(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + PORTION)))
        piece = data[start[a] : start[b - 1] + size[b - 1]]
        at = start[a:b] - start[a]
        out[a:b] = span_hash(prefix_hash(piece, BYTE_VALUE_CASE), at, at + size[a:b])
        a = b
    return out


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of an ordered array."""
    present, first = np.unique(owner, return_index=True)
    for s, a, b in zip(present.tolist(), first.tolist(), [*first.tolist()[1:], len(owner)], strict=True):
        yield s, slice(a, b)


def remove_repeats(docs: DataFrame, length: int = 50, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: byte spans of a text that a smaller document holds, and the bytes that stay."""
    rows = steady(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // SHARD_BYTES))
    most = CROWDED

    def ask_anchors(table: pa.Table) -> Iterator[Message]:
        segments = Segments(table, length)
        anchors, several, number = segments.anchors()
        # Bytes of an anchor's segments in this block, as the power of two of a segment's most that holds them.
        power = np.ceil(np.log2(np.maximum(1, np.bincount(number, weights=segments.size, minlength=len(anchors)) / (2 * length)))).astype(np.uint8)
        for shard, part in _by_owner(_shard(anchors, shards)):
            # Half of the hash names an anchor within its shard; a chance meeting only costs a segment sent.
            short = anchors[part] & np.uint64(0xFFFFFFFF)
            order = np.argsort(short, kind="stable")
            yield shard, pack(slim(np.diff(short[order], prepend=np.uint64(0))), np.packbits(several[part][order]), power[part][order])

    def answer_anchors(shard: int, blocks: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        asked = [unpack(b) for b in bodies]
        values = [np.cumsum(a.astype(np.int64)) for a, _, _ in asked]
        flags = [np.unpackbits(f, count=len(v)).astype(bool) for v, (_, f, _) in zip(values, asked, strict=True)]
        every = np.sort(np.concatenate([np.concatenate([v, v[f]]) for v, f in zip(values, flags, strict=True)]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        held = np.zeros(len(twice))
        found = []
        for v, (_, _, power) in zip(values, asked, strict=True):
            at = np.minimum(np.searchsorted(twice, v), max(0, len(twice) - 1))
            found.append((at, twice[at] == v if len(twice) else np.zeros(len(v), bool)))
            held += np.bincount(at[found[-1][1]], weights=2.0 * length * 2.0 ** power[found[-1][1]], minlength=len(twice))
        for block, (at, shared) in zip(blocks, found, strict=True):
            full = shared & (held[at] > most) if len(twice) else shared
            yield block, pack(np.packbits(shared), np.packbits(full))

    def send_segments(block: int, table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        segments = Segments(table, length)
        anchors, _, number = segments.anchors()
        shared, full = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        for shard, part in _by_owner(_shard(anchors, shards)):
            order = np.argsort(anchors[part] & np.uint64(0xFFFFFFFF), kind="stable")
            for flags, told in zip((shared, full), unpack(answers[shard]), strict=True):
                flags[part.start + order] = np.unpackbits(told, count=len(order)).astype(bool)
        crowded, wanted = anchors[full], shared[number]
        if len(crowded):
            wanted = wanted[~segments.scatter(crowded)]
            wanted = np.concatenate([wanted, np.ones(len(segments.anchor) - len(wanted), bool)])
        one, _, least = segments.distinct()
        sent = np.flatnonzero(wanted[one])
        one, least = one[sent], least[sent]
        out: list[Message] = []
        for shard, part in _by_owner(_shard(segments.anchor[one], shards)):
            mine = one[part]
            data = segments.data[ragged(segments.start[mine], segments.size[mine])]
            group = (segments.anchor[mine] >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)
            out.append((shard, pack(slim(np.diff(sent[part], prepend=0)), group, slim(segments.size[mine]), least[part], data, crowded)))
            crowded = crowded[:0]  # the first message carries them; they come back with its answer
        return pa.Table.from_batches([message_rows([block] * len(out), [s for s, _ in out], [b for _, b in out])])

    def expand(shard: int, blocks: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [unpack(b) for b in bodies]
        group, size = (joined([p[k] for p in parts], np.int64) for k in (1, 2))
        owner, data = joined([p[3] for p in parts], np.int64), joined([p[4] for p in parts], np.uint8)
        sent, crowded = [p[0] for p in parts], [p[5] for p in parts]
        del parts
        start = np.cumsum(size) - size
        content = _contents(data, start, size)
        order = np.lexsort((content, group))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[order][1:] != group[order][:-1]) | (content[order][1:] != content[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        least = np.minimum.reduceat(owner[order], np.flatnonzero(fresh)) if len(order) else owner
        windows = size[one] - length + 1
        result = np.zeros(int(windows.sum()), np.int64)
        begin = np.cumsum(windows) - windows
        # Portions of whole groups, so that equal windows stay together.
        filled = np.cumsum(size[one] + 1)
        cuts, edge = [0], np.flatnonzero(np.diff(group[one], append=-1)) + 1 if len(one) else np.zeros(0, np.int64)
        for k, e in enumerate(edge):
            more = filled[edge[k + 1] - 1] if k + 1 < len(edge) else np.inf
            if more - (filled[cuts[-1] - 1] if cuts[-1] else 0) > PORTION:
                cuts.append(int(e))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = one[a:b]
            found = smallest_owners(data[ragged(start[mine], size[mine])], size[mine], least[a:b], length)
            result[begin[a] : begin[a] + len(found)] = found
        # Runs of windows with one owner.
        turn = np.ones(len(result), bool)
        turn[1:] = result[1:] != result[:-1]
        turn[begin] = True
        runs_at = np.flatnonzero(turn)
        run_size = np.diff(np.append(runs_at, len(result)))
        first_run = np.searchsorted(runs_at, begin)
        run_count = np.diff(np.append(first_run, len(runs_at)))
        at = 0
        for block, kinds, back in zip(blocks, sent, crowded, strict=True):
            mine = number[at : at + len(kinds)]
            at += len(kinds)
            runs = ragged(first_run[mine], run_count[mine])
            yield block, pack(kinds, slim(run_count[mine]), slim(run_size[runs]), result[runs_at[runs]], back)

    def cut(block: int, table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        segments = Segments(table, length)
        told = [unpack(answers[shard]) for shard in sorted(answers)]  # shards and their segments are in the order of the anchors
        crowded = joined([t[4] for t in told], np.uint64)
        if len(crowded):
            segments.scatter(crowded)
        one, kind, _ = segments.distinct()
        runs, sizes, least = np.zeros(len(one), np.int64), [], []
        for number, run_count, run_size, owner, _ in told:
            runs[np.cumsum(number.astype(np.int64))] = run_count
            sizes.append(run_size)
            least.append(owner)
        run_size, least = joined(sizes, np.int64), joined(least, np.int64)
        first_run = np.cumsum(runs) - runs
        mine = runs[kind]
        of = ragged(first_run[kind], mine)  # all runs of all segments
        begin = np.zeros(len(of), np.int64)
        if len(of):
            before = np.cumsum(run_size[of]) - run_size[of]
            head = np.cumsum(mine) - mine
            begin = np.repeat(segments.start, mine) + before - np.repeat(before[np.minimum(head, len(of) - 1)], mine)
        owner = np.repeat(segments.owners[segments.doc], mine)
        gone = (least[of] < owner) & (owner != NOBODY)
        change = np.zeros(len(segments.data) + 1, np.int32)
        np.add.at(change, begin[gone], 1)
        np.add.at(change, (begin + run_size[of] + length - 1)[gone], -1)
        covered = np.cumsum(change[:-1]) > 0
        return _kept(table, segments, covered)

    asked = questions(rows, ask_anchors)
    sent = by_block(rows, by_shard(asked, answer_anchors), send_segments, MESSAGE)
    return by_block(rows, by_shard(sent, expand), cut, KEPT_SCHEMA)


def _kept(table: pa.Table, segments: Segments, covered: np.ndarray) -> pa.Table:
    """Spans and remaining bytes of every text of a block."""
    offsets, n = segments.offsets, len(segments.offsets) - 1
    edge = np.zeros(len(covered) + 1, bool)
    edge[offsets[:-1]] = True
    begins = covered.copy()
    begins[1:] &= ~covered[:-1] | edge[1 : len(covered)]
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | edge[1 : len(covered)]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    lists = np.searchsorted(doc, np.arange(n + 1))
    spans = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(end - offsets[doc])], ["start", "end"])
    stays = np.concatenate([[0], np.cumsum(~covered)])[offsets]
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(stays.astype(np.int32).tobytes()), pa.py_buffer(segments.data[~covered].tobytes())])
    return pa.table({"doc_id": table["doc_id"], "n_bytes": np.diff(offsets), "spans": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans), "kept": kept})
