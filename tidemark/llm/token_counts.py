"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch's distinct pre-tokens stand in one flat array of symbols with a sequence number for each. Every round looks up the
rank of all neighbouring pairs, finds the lowest rank of each sequence and merges all its occurrences at once, from the
left where they overlap; sequences without a known pair leave the arrays, and the symbols that survive are counted. A pair
that holds a merged symbol always ranks behind the merge that made the symbol, so merging all occurrences together gives
what merging them one by one gives.

How it scales: no shuffle. Texts are cut at single spaces, equal pieces of a chunk are counted once, and pieces met before
are kept in a bounded memory of the worker (a cache: emptied when full, never a limit). Texts in which a space stands next
to other white space, or that hold a special token's string, take the general path over their whole pre-token list.

Defined results: a null text is empty and has 0 tokens; the vocabulary's special strings count as one token where they
stand in a text; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import ship
from tidemark.llm.packed import chunks, text_buffer

#: White space and pre-token pattern of the byte-level vocabulary.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
MEMORY = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary as arrays, with a memory of counts by pre-token and by piece."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([vocab["".join(p)] for p in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        # A piece between single spaces can be cut by itself unless white space stands at its edge.
        self.edge = f"^$|^[{WHITE}]|[{WHITE}]$"
        self.seen: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def surviving(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence when no pair can merge any more."""
        counts = lengths.astype(np.int64).copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        none = np.int64(1) << 40
        while len(symbols) > 1:
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.ranks[at], none), none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            hit = (rank == np.repeat(lowest, sizes)) & (rank < none)
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run_start) % 2 == 0
            symbols = symbols.copy()
            spots = np.flatnonzero(hit)
            symbols[spots] = self.merged[at[spots]]
            stay = np.repeat(lowest < none, sizes)
            counts[owner[first]] = sizes
            stay[spots + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if len(symbols):
            counts[owner[0]] = 1
        return counts

    def count_new(self, words: list[str]) -> None:
        """Count pre-tokens that are not in memory yet."""
        data, offsets = text_buffer(pa.array(words, pa.large_string()))
        counts = self.surviving(self.byte_ids[data], np.diff(offsets))
        self.seen.update(zip(words, counts.tolist(), strict=True))

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of texts without special strings, each over its whole list of pre-tokens."""
        cut = [self.pattern.findall(t) for t in texts]
        fresh = [w for w in set(chain.from_iterable(cut)) if w not in self.seen]
        if len(self.seen) + len(fresh) > MEMORY:
            self.seen.clear()
            fresh = list(set(chain.from_iterable(cut)))
        self.count_new(fresh)
        get = self.seen.__getitem__
        return [sum(map(get, words)) for words in cut]

    def wholes(self, texts: list[str]) -> list[int]:
        """Tokens of any texts: special strings cut them and count one each."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        counts = iter(self.totals(list(chain.from_iterable(parts))))
        return [sum(islice(counts, len(p))) + len(p) - 1 for p in parts]

    def count(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """Tokens of every text of a column."""
        texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        where, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        odd_piece = pc.match_substring_regex(distinct, "[\\s\\x0b\\x1c-\\x1f\\x85]$|^[\\s\\x0b\\x1c-\\x1f\\x85]|^$").to_numpy(zero_copy_only=False)
        # Beyond ASCII the white space of the two pattern libraries may differ: look again with the pattern itself.
        strings = distinct.to_pylist()
        edge = regex.compile(self.edge)
        wide = np.flatnonzero(pc.not_equal(pc.binary_length(distinct), pc.cast(pc.utf8_length(distinct), pa.int64())).to_numpy(zero_copy_only=False))
        for k in wide:
            odd_piece[k] |= edge.search(strings[k]) is not None
        n = len(texts)
        odd = np.zeros(n, bool)
        odd[np.repeat(np.arange(n), np.diff(offsets))[odd_piece[where]]] = True
        if self.special:
            odd |= pc.match_substring_regex(texts, self.special.pattern.replace("\\<", "<").replace("\\>", ">")).to_numpy(zero_copy_only=False)
        first = np.zeros(len(where), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        plain = ~np.repeat(odd, np.diff(offsets))
        out = np.zeros(n, np.int64)
        inner = np.flatnonzero(plain & ~first)
        if len(inner):
            used, back = np.unique(where[inner], return_inverse=True)
            spaced = [" " + strings[k] for k in used]
            unknown = [s for s in spaced if s not in self.pieces]
            if len(self.pieces) + len(unknown) > MEMORY:
                self.pieces.clear()
                unknown = spaced
            self.pieces.update(zip(unknown, self.totals(unknown), strict=True))
            per_piece = np.fromiter(map(self.pieces.__getitem__, spaced), np.int64, len(spaced))
            owner = np.searchsorted(offsets, inner, "right") - 1
            out += np.bincount(owner, weights=per_piece[back], minlength=n).astype(np.int64)
        heads = np.flatnonzero(~odd)
        out[heads] += np.array(self.totals([strings[where[offsets[k]]] for k in heads]), np.int64) if len(heads) else 0
        rest = np.flatnonzero(odd)
        out[rest] = np.array(self.wholes(texts.take(pa.array(rest)).to_pylist()), np.int64) if len(rest) else 0
        return out


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every document; ``vocabulary`` is a byte-level BPE file present on every machine."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteBpe(vocabulary)
        for table in chunks(batches):
            size = pc.fill_null(pc.binary_length(table["text"]), 0).cast(pa.int64())
            yield from pa.table({"doc_id": table["doc_id"], "n_bytes": size, "n_tokens": pa.array(model.count(table["text"]))}).to_batches()

    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
