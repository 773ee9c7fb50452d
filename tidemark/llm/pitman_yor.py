"""Language model scores by a hierarchical Pitman-Yor process.

The word before a token, by its 64-bit hash, names its context restaurant; all
of them share one parent, the restaurant of single tokens, whose base is uniform over the vocabulary and one unknown
token. A dish in a context restaurant is kept as its customers ``c`` and tables ``t``; every table is a customer of the
parent. A sweep covers every customer. Dishes of ``MOVES`` customers at most have Gibbs moves, which take the last customer
out (alone at its table with probability ``S(c-1, t-1) / S(c, t)``, S the generalised Stirling numbers) and seat it again by
the Chinese-restaurant rule. The tables of all others are drawn at once from their distribution given the rest of the
restaurant, ``S(c, t)`` times the chances of ``t`` new tables, whatever the count. After ``BURN`` sweeps, ``SAMPLES`` sweeps
give predictive probabilities, which are averaged for each token; a text's score is the sum of their logarithms.

How it scales: dishes are sharded by the token's hash, so a token's parent dish stands beside its context dishes, and a
context that a third of all tokens share is spread over all shards. A sweep holds the totals of the restaurants fixed and
sums them anew at its end: restaurants have shards of their own, by the context's hash; every dish shard sends them the
tables that it holds of each context and gets the totals back. The driver sees four sums a sweep. Seating is drawn from seeds
of shard and sweep, so a lost task draws it again; the state of a sweep is written. Counts, totals and scores travel as packed
messages between blocks of texts and shards (``exchange``); what is gathered grows with the corpus, and so do the contexts.
Every text is scored whole.

Defined results: null and empty texts are one end token; held-out rows are scored and never counted; without training rows
every token is unknown; repeated rows count each time; null document ids are training rows; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, ship
from tidemark.llm.exchange import Message, by_block, by_shard, joined, pack, questions, slim, steady, unpack
from tidemark.llm.packed import SPACED, text_buffer, word_hashes
from tidemark.session import cut_lineage

BURN, SAMPLES = 2, 3
#: Gibbs moves in a sweep of every dish with so many customers at most; the tables of other dishes are drawn at once.
MOVES = 6
#: Table counts that are weighed at a time.
WEIGHED = 1 << 20
#: Discount and strength of the context restaurants and of the parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 2.0, 0.6, 1.0
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
#: Parts of the documents that are scored one after another; the messages of one part are on disk at a time.
PASSES = 3
END, START = np.uint64(0x5E0D_5E0D_5E0D_5E0D), np.uint64(0x57A7_57A7_57A7_57A7)
STIRLING_CUSTOMERS, STIRLING_TABLES = 512, 96


@cache
def alone(discount: float) -> np.ndarray:
    """[c, t]: the chance S(c-1, t-1) / S(c, t) that the last of c customers at t tables sits alone."""
    before = np.full(STIRLING_TABLES + 1, -np.inf)
    before[1] = 0.0  # log S(1, 1)
    out = np.zeros((STIRLING_CUSTOMERS + 1, STIRLING_TABLES + 1), np.float32)
    out[1, 1] = 1
    tables = np.arange(STIRLING_TABLES + 1)
    for c in range(2, STIRLING_CUSTOMERS + 1):
        with np.errstate(divide="ignore"):
            stay = before + np.log(np.maximum(c - 1 - discount * tables, 0))
        new = np.concatenate([[-np.inf], before[:-1]])
        after = np.logaddexp(stay, new)
        with np.errstate(invalid="ignore"):
            out[c] = np.where(np.isfinite(after), np.exp(new - after), 0)
        before = after
    return out


def moved(rng: np.random.Generator, customers: np.ndarray, tables: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, moves: int) -> np.ndarray:
    """Tables of dishes after Gibbs moves; ``base`` is the parent's probability, ``others`` the restaurants' tables."""
    tables = tables.astype(np.float64)
    many = customers >= 2
    c, t, p, total = customers[many].astype(np.float64), tables[many], base[many], others[many]
    chance = alone(discount)
    c_at = np.minimum(customers[many], STIRLING_CUSTOMERS).astype(np.int64)
    large = customers[many] > STIRLING_CUSTOMERS
    for _ in range(moves):
        # Beyond the stored numbers: their ratio for many customers.
        limit = np.minimum(1.0, (t - 1) * discount / (c - 1))
        leave = np.where(large | (t > STIRLING_TABLES), limit, chance[c_at, np.minimum(t, STIRLING_TABLES).astype(np.int64)])
        left = (rng.random(len(t)) < leave) & (t > 1)
        t = t - left
        fresh = (strength + discount * np.maximum(total - left, 0)) * p
        sit = np.maximum(c - 1 - discount * t, 0)
        t = t + (rng.random(len(t)) * (fresh + sit) < fresh)
    tables[many] = np.minimum(t, c)
    return tables


@cache
def _limit(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of customers a table, and ``u`` for which tables whose sizes have the weights of S, tilted by ``1 - exp(-u)``, hold that many."""
    u = np.geomspace(1e-6, 300, 1 << 13)
    mean = np.log(discount * -np.expm1(-u)) + (1 - discount) * u - np.log(-np.expm1(-discount * u))
    return np.concatenate([[0.0], mean]), np.concatenate([[0.0], u])


@cache
def _log_stored(discount: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(alone(discount))


def log_alone(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of ``S(c-1, t-1) / S(c, t)``, stored or, for more customers or tables, by the saddle point of the tables' sizes."""
    out = np.empty(len(customers))
    stored = (customers <= STIRLING_CUSTOMERS) & (tables <= STIRLING_TABLES)
    out[stored] = _log_stored(discount)[customers[stored], tables[stored]]
    beyond = np.flatnonzero(~stored)
    c, t = customers[beyond].astype(np.float64), tables[beyond].astype(np.float64)
    means, us = _limit(discount)
    out[beyond] = np.where(t > 1, -(1 - discount) * np.interp(np.log((c - 1) / np.maximum(t - 1, 1)), means, us), -np.inf)
    return out


def log_step(customers: np.ndarray, tables: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Logarithm of how much likelier ``t`` tables of a dish are than ``t - 1``, for t of 2 or more; ``others`` are the other dishes' tables."""
    fresh = (strength + discount * (others + tables - 1)) * base
    stay = np.maximum(-np.expm1(log_alone(customers, tables - 1, discount)), 1e-12)
    return np.log(fresh * stay / (customers - 1 - discount * (tables - 1))) - log_alone(customers, tables, discount)


def drawn(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Tables of dishes of two customers or more, drawn from their distribution given the other dishes' tables.

    The steps between neighbouring counts fall, so the likeliest count is found by halving; counts are weighed as far around
    it as they have weight.
    """
    out = np.ones(len(customers), np.int64)
    low, high = out.copy(), customers.astype(np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        up = log_step(customers[open_], middle, base[open_], others[open_], discount, strength) >= 0
        low[open_] = np.where(up, middle, low[open_])
        high[open_] = np.where(up, high[open_], middle - 1)
    near = np.minimum(low + np.maximum(1, np.sqrt(low).astype(np.int64)), customers)
    near, far = np.minimum(near, customers - 1) + 1, np.maximum(low, 2)
    fall = log_step(customers, far, base, others, discount, strength) - log_step(customers, np.maximum(near, far), base, others, discount, strength)
    reach = np.sqrt(np.maximum(near - far, 1) / np.maximum(fall, 1e-9))
    reach = 12 + np.ceil(9 * np.minimum(reach, 4 * np.sqrt(low + 1.0))).astype(np.int64)
    first = np.maximum(1, low - reach)
    width = np.minimum(customers, low + reach) - first + 1
    ends = np.cumsum(width)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WEIGHED, "right")))
        size, dish = width[a:b], np.repeat(np.arange(a, b), width[a:b])
        begin = np.cumsum(size) - size
        t = np.arange(len(dish)) - np.repeat(begin - first[a:b], size)
        weight = np.zeros(len(dish))
        steps = np.ones(len(dish), bool)
        steps[begin] = False
        at = dish[steps]
        weight[steps] = log_step(customers[at], t[steps], base[at], others[at], discount, strength)
        weight = np.cumsum(weight)
        weight = np.cumsum(np.exp(weight - np.repeat(np.maximum.reduceat(weight, begin), size)))
        before = np.concatenate([[0.0], weight])[begin]
        last = begin + size - 1
        found = np.searchsorted(weight, before + rng.random(b - a) * (weight[last] - before), "right")
        out[a:b] = t[np.minimum(np.maximum(found, begin), last)]
        a = b
    return out


def seated(rng: np.random.Generator, customers: np.ndarray, tables: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Tables of dishes after a sweep over all their customers; ``others`` are the restaurants' tables."""
    customers, out = customers.astype(np.int64), np.array(tables, np.float64)
    few = customers <= MOVES
    out[few] = moved(rng, customers[few], tables[few], base[few], others[few], discount, strength, MOVES)
    rest = np.maximum(others[~few] - tables[~few], 0)
    out[~few] = drawn(rng, customers[~few], base[~few], rest, discount, strength)
    return out


class Tokens:
    """Tokens of a block's texts: distinct token hashes, distinct (token, context) cells, and every token's cell."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        hashes, owner = word_hashes(*text_buffer(texts), SPACED)
        n = len(texts)
        self.counts = np.bincount(owner, minlength=n) + 1
        self.ends = np.cumsum(self.counts)
        tokens = np.empty(len(hashes) + n, np.uint64)
        last = np.zeros(len(tokens), bool)
        last[self.ends - 1] = True
        tokens[last], tokens[~last] = END, hashes
        self.words, word = coded(tokens)
        # Contexts are words too, or the start: their places follow from those of the words.
        at = int(np.searchsorted(self.words, START))
        names, after = self.words, word
        if at == len(names) or names[at] != START:
            names, after = np.insert(names, at, START), word + (word >= at)
        place = np.empty(len(tokens), np.int64)
        place[1:] = after[:-1]
        place[self.ends - self.counts] = at
        held = np.zeros(len(names), bool)
        held[place] = True
        self.contexts, context = names[held], (np.cumsum(held) - 1)[place]
        self.cells, self.cell = np.unique(word * len(self.contexts) + context, return_inverse=True)
        self.word_of, self.context_at = self.cells // len(self.contexts), self.cells % len(self.contexts)
        self.context_of = self.contexts[self.context_at]
        self.starts = np.searchsorted(self.word_of, np.arange(len(self.words) + 1))

    def shards(self, count: int) -> list[tuple[int, slice, slice]]:
        """Each shard that the block needs, with its words and its cells."""
        owner = shard_of(self.words, count)
        present, first = np.unique(owner, return_index=True)
        bounds = np.append(first, len(self.words))
        return [(int(s), slice(a, b), slice(self.starts[a], self.starts[b])) for s, a, b in zip(present, bounds[:-1], bounds[1:], strict=True)]

    def message(self, words: slice, cells: slice, *counts: np.ndarray) -> bytes:
        """Words, cells per word, each cell's context by its place, counts, and the contexts in order."""
        present, at = np.unique(self.context_at[cells], return_inverse=True)
        per_word = np.diff(self.starts[words.start : words.stop + 1])
        return pack(self.words[words], slim(per_word), slim(at), *counts, steps(self.contexts[present]))


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and every value's place among them; they are hashed, so that only distinct ones are sorted."""
    encoded = pa.array(values).dictionary_encode()
    names = encoded.dictionary.to_numpy()
    order = np.argsort(names)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return names[order], place[encoded.indices.to_numpy()]


def steps(names: np.ndarray) -> np.ndarray:
    """Names in order as differences; ``np.cumsum`` gives them back."""
    return np.diff(names, prepend=np.uint64(0))


def ranges(names: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """Each shard of names in order, with its part of them."""
    present, first = np.unique(shard_of(names, count), return_index=True)
    for s, a, b in zip(present.tolist(), first.tolist(), [*first.tolist()[1:], len(names)], strict=True):
        yield s, slice(a, b)


def shard_of(words: np.ndarray, count: int) -> np.ndarray:
    """Ranges of the upper hash bits, so that sorted words are sorted by shard."""
    return ((words >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


class Shard:
    """Dishes of the words of one shard, from messages of (words, cells per word, contexts, training counts).

    Contexts are names, or places in a fifth array of ordered names.
    """

    def __init__(self, bodies: list[bytes]) -> None:
        parts = [unpack(b) for b in bodies]
        words = joined([p[0] for p in parts], np.uint64)
        per_word = joined([p[1] for p in parts], np.int64)
        self.words, word = np.unique(words, return_inverse=True)
        names = [np.cumsum(p[4]) if len(p) > 4 else p[2] for p in parts]
        self.contexts, place = np.unique(joined(names, np.uint64), return_inverse=True)
        begin = np.cumsum([0, *map(len, names)])
        context = [place[a + p[2].astype(np.int64)] if len(p) > 4 else place[a:b] for a, b, p in zip(begin[:-1], begin[1:], parts, strict=True)]
        keys = np.repeat(word, per_word)
        keys *= len(self.contexts)
        keys += joined(context, np.int64)
        del names, place, context, word
        counts = joined([p[3] for p in parts], np.int64)
        self.keys, cell = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(cell, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.prepare()

    @classmethod
    def restored(cls, body: bytes) -> Shard:
        self = cls.__new__(cls)
        self.words, contexts, keys, self.counts = unpack(body)
        self.contexts = np.cumsum(contexts)
        self.keys, self.counts = np.cumsum(keys.astype(np.int64)), self.counts.astype(np.int64)
        self.prepare()
        return self

    def stored(self) -> bytes:
        return pack(self.words, steps(self.contexts), slim(np.diff(self.keys, prepend=0)), slim(self.counts))

    def prepare(self) -> None:
        many = max(1, len(self.contexts))
        self.word, self.context = (self.keys // many).astype(np.int32), (self.keys % many).astype(np.int32)
        self.word_counts = np.bincount(self.word, weights=self.counts, minlength=len(self.words)).astype(np.int64)

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts)).astype(np.int64)

    def customers(self, tables: np.ndarray) -> np.ndarray:
        """The parent's customers by word."""
        return np.bincount(self.word, weights=tables, minlength=len(self.words)).astype(np.float64)

    def totals(self, tables: np.ndarray, root_tables: np.ndarray) -> np.ndarray:
        """Tables by context, then the customers and the tables of the parent."""
        return np.concatenate([self.by_context(tables), [tables.sum(), root_tables.sum()]]).astype(np.int64)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables by cell and by word at the start."""
        tables = np.ones(len(self.keys))
        return tables, np.minimum(1.0, self.customers(tables))

    def swept(self, shard: int, sweep: int, tables: np.ndarray, root: np.ndarray, total: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables by cell and by word after one more sweep; ``total`` is of the seating before, as ``totals`` has it."""
        rng = np.random.default_rng([shard, sweep, 977])
        base = root_probability(self.customers(tables), root, total, vocabulary)
        tables = seated(rng, self.counts, tables, base[self.word], total[self.context].astype(np.float64), DISCOUNT, STRENGTH)
        customers = self.customers(tables)
        flat = np.full(len(self.words), 1.0 / (vocabulary + 1))
        root = seated(rng, customers, np.minimum(root, customers), flat, np.full(len(self.words), float(total[-1])), ROOT_DISCOUNT, ROOT_STRENGTH)
        return tables, root

    def seatings(self, shard: int, history: list[np.ndarray], vocabulary: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables by cell, customers and tables by word: the first seating, then one more for each known total."""
        tables, root = self.first()
        yield tables, self.customers(tables), root
        for sweep, total in enumerate(history):
            tables, root = self.swept(shard, sweep, tables, root, total, vocabulary)
            yield tables, self.customers(tables), root


def root_probability(customers: np.ndarray, tables: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """The parent's probability of words with so many customers and tables; unknown words have none. ``total`` ends with its sums."""
    held = customers - ROOT_DISCOUNT * tables
    spare = (ROOT_STRENGTH + ROOT_DISCOUNT * total[-1]) / (vocabulary + 1)
    return (np.maximum(held, 0) + spare) / (ROOT_STRENGTH + total[-2])


#: Names of the rows of a shard that are no messages of blocks: its dishes or contexts, its sums, where each shard of dishes has its contexts, its seating after sweep s at SEATING - s.
STORED, SUMS, PLACES, SEATING = -1, -2, -3, -4


def _sums(rows: DataFrame) -> np.ndarray:
    """Four sums over all shards: tables, tables of the parent, words, tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                yield pa.RecordBatch.from_pydict({k: [int(v)] for k, v in zip("abcd", unpack(body.as_py())[0], strict=True)})

    sums = rows.where(F.col("block") == SUMS).mapInArrow(read, "a bigint, b bigint, c bigint, d bigint")
    return np.array([v or 0 for v in sums.agg(*(F.sum(c) for c in "abcd")).first()], np.int64)


def _told(shard: Shard, shards: int, tables: np.ndarray, root: np.ndarray, *, named: bool = False) -> Iterator[tuple[int, bytes]]:
    """What a shard tells of a seating: its sums, and its tables by context to the shards of contexts; with names and customers at the start."""
    yield SUMS, pack(np.array([tables.sum(), root.sum(), len(shard.words), shard.counts.sum()], np.int64))
    by_context, customers = shard.by_context(tables), shard.by_context(shard.counts) if named else None
    for number, part in ranges(shard.contexts, shards):
        yield number, pack(slim(by_context[part]), *((slim(customers[part]), steps(shard.contexts[part])) if named else ()))


def _totals(shard: int, shards: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Sums by context: for the shard itself, and for each shard of dishes in the order that it named its contexts in."""
    held = {number: unpack(body) for number, body in zip(shards, bodies, strict=True)}
    places, parts = held.pop(PLACES, None), list(held.values())
    sizes = [len(p[0]) for p in parts]
    begin = np.cumsum([0, *sizes])
    if places:
        at = joined([np.cumsum(x.astype(np.int64)) for x in np.split(places[0], begin[1:-1])], np.int64)
        sums = [np.bincount(at, weights=joined([p[0] for p in parts], np.int64)).astype(np.int64)]
        yield STORED, pack(slim(sums[0]))
    else:
        names, at = np.unique(joined([np.cumsum(p[2]) for p in parts], np.uint64), return_inverse=True)
        sums = [np.bincount(at, weights=joined([p[k] for p in parts], np.int64)).astype(np.int64) for k in (0, 1)]
        yield STORED, pack(steps(names), slim(sums[1]))
        yield PLACES, pack(slim(joined([np.diff(at[a:b], prepend=0) for a, b in zip(begin[:-1], begin[1:], strict=True)], np.int64)))
    for number, a, b in zip(held, begin[:-1], begin[1:], strict=True):
        yield number, pack(slim(sums[0][at[a:b]]))


def _turned(rows: DataFrame) -> DataFrame:
    """Messages between shards, sent to whom they name."""
    return rows.where(F.col("block") >= 0).select(F.col("shard").cast("bigint").alias("block"), F.col("block").cast("int").alias("shard"), "body")


class Model:
    """A fitted model: written tables of its shards of dishes and of contexts, and sums of the sampled seatings."""

    def __init__(self, training: DataFrame) -> None:
        """``training`` has a text column only."""
        spark = training.sparkSession
        ship(spark)
        size = training.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        self.shard_count = shards = max(1, -(-size // SHARD_BYTES))

        def ask(table: pa.Table) -> Iterator[Message]:
            tokens = Tokens(table["text"])
            counts = np.bincount(tokens.cell, minlength=len(tokens.cells))
            for shard, words, cells in tokens.shards(shards):
                yield shard, tokens.message(words, cells, slim(counts[cells]))

        def merge(number: int, blocks: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
            shard = Shard(bodies)
            yield STORED, shard.stored()
            yield from _told(shard, shards, *shard.first(), named=True)

        seating = cut_lineage(by_shard(questions(training.select("text"), ask), merge))
        dishes = seating.where(F.col("block") == STORED)
        sums = _sums(seating)
        self.vocabulary, self.tokens = int(sums[2]), int(sums[3])
        totals = cut_lineage(by_shard(_turned(seating), _totals))
        own, places = F.col("block") == STORED, totals.where(F.col("block") == PLACES)
        # Files of shuffles whose results are written go with the plans that hold them.
        spark._jvm.System.gc()
        #: Rows of the shards of dishes, and of those of contexts behind them.
        kept, written = [dishes, totals.where(own).withColumn("shard", F.col("shard") + shards)], [seating, totals]
        self.sums: list[np.ndarray] = []
        for sweep in range(BURN + SAMPLES - 1):
            state = seating.where(F.col("block") == SEATING - sweep)
            seating = cut_lineage(by_shard(dishes.unionAll(state).unionAll(_turned(totals)), self._sweep(sweep, sums[:2])))
            sums = _sums(seating)
            totals = cut_lineage(by_shard(_turned(seating).unionAll(places), _totals))
            written += [seating, totals]
            if sweep + 1 >= BURN:
                self.sums.append(sums[:2])
                kept.append(seating.where(F.col("block") == SEATING - sweep - 1))
                kept.append(totals.where(own).select(F.lit(SEATING - sweep - 1).cast("bigint").alias("block"), (F.col("shard") + shards).alias("shard"), "body"))
        # What is scored with goes into one table; the messages of training need no more disk.
        self.tables = [cut_lineage(reduce(DataFrame.unionAll, [k.select("block", "shard", "body") for k in kept]))]
        for table in written:
            forget(table)
        spark._jvm.System.gc()

    def _sweep(self, sweep: int, sums: np.ndarray):  # noqa: ANN202
        shards, vocabulary = self.shard_count, self.vocabulary

        def work(number: int, blocks: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
            held = dict(zip(blocks, bodies, strict=True))  # shards of contexts are in the order of the contexts
            shard = Shard.restored(held.pop(STORED))
            before = held.pop(SEATING - sweep, None)
            tables, root = (a.astype(np.float64) for a in (unpack(before) if before else shard.first()))
            total = np.concatenate([*(unpack(held[k])[0].astype(np.int64) for k in sorted(held)), sums])
            tables, root = shard.swept(number, sweep, tables, root, total, vocabulary)
            yield SEATING - sweep - 1, pack(slim(tables), slim(root))
            yield from _told(shard, shards, tables, root)

        return work

    def score(self, docs: DataFrame, kept: list[str]) -> DataFrame:
        """Scores of whole texts: the columns ``kept``, then tokens, known tokens and the two sums of logarithms."""
        shards, sums, vocabulary, n = self.shard_count, self.sums, self.vocabulary, self.tokens
        shown = [f for f in docs.schema.fields if f.name in kept]

        def ask(table: pa.Table) -> Iterator[Message]:
            tokens = Tokens(table["text"])
            for shard, words, cells in tokens.shards(shards):
                yield shard, tokens.message(words, cells)
            for shard, part in ranges(tokens.contexts, shards):
                yield shards + shard, pack(steps(tokens.contexts[part]))

        def answer(number: int, blocks: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
            own = {block: body for block, body in zip(blocks, bodies, strict=True) if block < 0}
            seatings = [unpack(own[k]) for k in sorted(own, reverse=True) if k <= SEATING]
            asked = ((block, unpack(body)) for block, body in zip(blocks, bodies, strict=True) if block >= 0)
            if number >= shards:
                names, counts = unpack(own[STORED]) if own else [np.zeros(0, np.uint64)] * 2
                names = np.cumsum(names)
                held = [counts, *(s[0] for s in seatings)] if own else [counts] * (1 + SAMPLES)
                for block, (contexts,) in asked:
                    at, known = found(names, np.cumsum(contexts))
                    yield block, pack(*(slim(taken(v, at, known)) for v in held))
                return
            shard = Shard.restored(own[STORED]) if own else Shard([])
            seatings = [(shard.customers(t), root, t) for t, root in seatings or [shard.first()] * SAMPLES]
            for block, (words, per_word, context, names) in asked:
                per_word = per_word.astype(np.int64)
                at, known = found(shard.words, words)
                place, there = found(shard.contexts, np.cumsum(names))
                cell, seated_ = found(shard.keys, np.repeat(at, per_word) * len(shard.contexts) + place[context])
                seated_ &= np.repeat(known, per_word) & there[context]
                out = [taken(shard.word_counts, at, known), taken(shard.counts, cell, seated_)]
                for customers, root, tables in seatings:
                    out += [taken(customers, at, known), taken(root, at, known), taken(tables, cell, seated_)]
                yield block, pack(*map(slim, out))

        def scored(block: int, table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
            tokens = Tokens(table["text"])
            held: list[list[np.ndarray]] = []
            for shard, words, cells in tokens.shards(shards):
                parts = unpack(answers.pop(shard))
                if len(parts[0]) != words.stop - words.start or len(parts[1]) != cells.stop - cells.start:
                    raise RuntimeError("an input task gave other rows than before; write the input to files first")
                held.append(parts)
            parts = [unpack(answers.pop(shards + shard)) for shard, _ in ranges(tokens.contexts, shards)]

            def gathered(k: int) -> np.ndarray:
                """One array of all shards' answers; they stay in their narrow types until then."""
                return joined([h[k] for h in held], np.int64)

            def by_context(k: int) -> np.ndarray:
                return joined([p[k] for p in parts], np.int64)[tokens.context_at]

            seen, customers, counts = gathered(0), gathered(1), by_context(0)
            mean = np.zeros(len(tokens.cells))
            for s in range(SAMPLES):
                parent = root_probability(gathered(2 + 3 * s), gathered(3 + 3 * s), sums[s], vocabulary)[tokens.word_of]
                spare = STRENGTH + DISCOUNT * by_context(1 + s)
                mean += (np.maximum(customers - DISCOUNT * gathered(4 + 3 * s), 0) + spare * parent) / (STRENGTH + counts) / SAMPLES
            starts = tokens.ends - tokens.counts
            of_cell = {"score": np.log10(mean), "base_score": np.log10((seen + 0.1) / (n + 0.1 * (vocabulary + 1)))[tokens.word_of], "n_known": (seen > 0)[tokens.word_of].astype(np.int64)}
            sums_ = {k: np.add.reduceat(v[tokens.cell], starts) for k, v in of_cell.items()}
            columns = {f.name: table[f.name] for f in shown} | {"n_tokens": tokens.counts, "n_known": sums_["n_known"], "base_score": sums_["base_score"], "score": sums_["score"]}
            return pa.table(columns)

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown), "n_tokens bigint, n_known bigint, base_score double, score double"])
        number = F.pmod(F.xxhash64(*kept, F.crc32(F.col("text").cast("binary"))), F.lit(PASSES))
        out = None
        for k in range(PASSES):
            some = docs.where(number == k)
            asked = questions(some, ask)
            for rows in self.tables:
                asked = asked.unionAll(rows.select("block", "shard", "body"))
            part = cut_lineage(by_block(some, by_shard(asked, answer).where("block >= 0"), scored, schema))
            docs.sparkSession._jvm.System.gc()
            out = part if out is None else out.unionAll(part)
        return out


def taken(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Values at places, 0 where there is none."""
    return np.where(there, values[at], 0).astype(np.int64) if len(values) else np.zeros(len(at), np.int64)


def found(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in an ordered array, and whether they are there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


def score_texts(docs: DataFrame, held_out: Column, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; held-out rows are not learnt."""
    rows = steady(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text")))
    model = Model(rows.where(~F.col("held_out")).select("text"))
    return model.score(rows, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the held-out and of the training texts, by the model and by the base."""
    total = F.sum("n_tokens")
    return scores.groupBy("held_out").agg(total.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / total).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / total).alias("base_perplexity"))
