"""How far the sources of each language differ in their words: term stripes folded in the mapper, merged by key.

Every task folds whole documents into hash stripes, one for each (language, term): the number of documents that hold the
term and, for each source, how often it stands there. A task that holds ``HELD`` counts spills its stripes and goes on.
Stripes are merged by (language, term); the terms in at least ``least`` documents of the language stay, and the stripe of
the empty term lists the language's sources, those without terms too. Merged stripes give the sizes of all groups, and are
read once more to emit divergences directly: a stripe holds all counts of its term, so the shares ``p`` and ``q`` of each pair of
sources stand side by side and no rows of terms are joined.

Shares are ``1 + floor(SCALE * (count + 1) / (N + V))`` and a divergence ``floor((p - q)^2 / q)``, all in whole numbers: the
division goes by three steps of a thousand, so it is exact while a language has fewer than 9e15 words.

How it scales: the shuffle holds one stripe for each term and spill, not the words. Emitting tasks take stripes of one
language, dealt by a hash of the term into parts of about ``PART`` counts, so a language with most rows is spread; a hot term
is one stripe. Where a pair's two counts are both none, its part of the sum is the same for all terms: it is added once as
V times that, and a stripe costs its own sources times all sources. Sums are kept in panels of at most ``CELLS`` pairs of sources;
more sources make more panels. Each task keeps its ``top`` terms of every source (all ties), Spark ranks what is left.

Defined results: null text, language and source read as ''; texts without terms still show their group; repeated rows count
as documents of their own; a language without kept terms has pairs of value 0 and no terms; languages with one source have
no pairs; an empty table gives no rows; other columns are ignored, and very long texts are folded in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.packed import give_back, ragged
from tidemark.operators.slices import lookup_join
from tidemark.session import cut_lineage

#: Counts that a task folds before it spills; one takes some 200 bytes.
HELD = 250_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Counts that one emitting task reads, and pairs of sources that it sums.
PART, CELLS = 400_000, 1 << 21
#: Shares are counted in billionths.
SCALE = 1000**3

#: A-Z to a-z, other letters and bytes beyond ASCII as they are, all else to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end with a word."""
    at = 0
    while at < len(text):
        upto = at + PIECE
        while upto < len(text) and _WORD_BYTES[text[upto]] != 32:
            upto += 1
        yield text[at:upto]
        at = upto


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into stripes, handed on whenever ``HELD`` counts are held."""
    stripes: dict[str, dict[bytes, list]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            found: Counter[bytes] = Counter()
            for piece in _pieces(text.as_py()):
                found.update(piece.translate(_WORD_BYTES).split())
            mine = stripes.setdefault(lang, {})
            for term, n in ((b"", 0), *found.items()):
                stripe = mine.get(term)
                if stripe is None:
                    stripe = mine[term] = [0, {}]
                stripe[0] += 1
                by_source = stripe[1]
                before = len(by_source)
                by_source[source] = by_source.get(source, 0) + n
                held += len(by_source) - before
            if held >= HELD:
                yield from _spilled(stripes)
                stripes, held = {}, 0
    yield from _spilled(stripes)
    give_back()


def _spilled(stripes: dict[str, dict[bytes, list]]) -> Iterator[pa.RecordBatch]:
    for lang, mine in stripes.items():
        columns = [[lang] * len(mine), list(mine), [s[0] for s in mine.values()], [list(s[1]) for s in mine.values()], [list(s[1].values()) for s in mine.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STRIPE.types, strict=True)], schema=_STRIPE)


def term_stripes(docs: DataFrame, least: int = 3) -> DataFrame:
    """``lang, term, df, counts`` (an array of ``source, n``) of all terms in ``least`` documents of their language.

    The stripe of the term '' lists every source of the language with a count of 0.
    """
    ship(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    folded = plain.mapInArrow(_fold, "lang string, term binary, df bigint, sources array<string>, counts array<bigint>")
    # A stripe's documents are counted once, on the first of its sources.
    rows = folded.repartition("lang", "term").select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")).alias("k", "s"))
    merged = rows.groupBy("lang", "term", F.col("s.sources").alias("source")).agg(F.sum(F.when(F.col("k") == 0, F.col("df")).otherwise(0)).alias("df"), F.sum("s.counts").alias("n"))
    stripes = merged.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return stripes.where((F.col("df") >= least) | (F.length("term") == 0)).withColumn("term", F.col("term").cast("string"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals under 9e15."""
    rest, out = counts + 1, np.zeros(1, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def chi(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _emit(top: int):
    """Pair sums of a panel of sources and the first terms of each, from one part of a language's stripes."""

    def emitted(stripes: pa.Table, groups: pa.Table) -> pa.Table:
        order = np.argsort(groups["place"].to_numpy())
        names = groups["source"].take(pa.array(order))
        totals = groups["size"].to_numpy()[order] + groups["v"][0].as_py()
        whole = np.int64(groups["lang_size"][0].as_py() + groups["v"][0].as_py())
        n, low, high = len(totals), groups["low"][0].as_py(), min(len(totals), groups["high"][0].as_py())
        none = shares(np.zeros(n, np.int64), totals)
        base = chi(none[low:high, None], none)
        sums = base * len(stripes)
        places = stripes["places"].combine_chunks() if len(stripes) else pa.array([], pa.list_(pa.int64()))
        ends = np.cumsum(np.diff(places.offsets.to_numpy()))
        sources, found = places.flatten().to_numpy(), stripes["ns"].combine_chunks().flatten().to_numpy() if len(stripes) else np.zeros(0, np.int64)
        values, owners, at = [], [], 0
        best: dict[int, np.ndarray] = {}
        while at < len(places):
            begun = ends[at - 1] if at else 0
            # A step has at most ``CELLS`` shares of stripes by sources, and of counts by sources.
            upto = max(at + 1, min(at + CELLS // n, int(np.searchsorted(ends, begun + CELLS // n, "right"))))
            some = slice(int(begun), int(ends[upto - 1]))
            rows = np.repeat(np.arange(upto - at), np.diff(np.concatenate([[begun], ends[at:upto]])))
            counts = np.zeros((upto - at, n), np.int64)
            counts[rows, sources[some]] = found[some]
            p = shares(counts, totals)
            for first in range(0, len(rows), max(1, CELLS // n)):
                r, s = rows[first : first + CELLS // n], sources[some][first : first + CELLS // n]
                mine = p[r, s]
                inside = (s >= low) & (s < high)
                # Pairs whose first source has the term, then those whose second alone has it.
                by = np.argsort(s[inside], kind="stable")
                if len(by):
                    here, own = s[inside][by], mine[inside][by]
                    more = chi(own[:, None], p[r[inside][by]]) - base[here - low]
                    starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                    sums[here[starts] - low] += np.add.reduceat(more, starts, axis=0)
                by = np.argsort(s, kind="stable")
                r, s, mine = r[by], s[by], mine[by]
                more = np.where(counts[r, low:high] > 0, 0, chi(p[r, low:high], mine[:, None]) - base[:, s].T)
                starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                sums[:, s[starts]] += np.add.reduceat(more, starts, axis=0).T
            q = shares(counts.sum(axis=1), whole)
            mine, q = p[rows, sources[some]], q[rows]
            good = np.flatnonzero((mine > q) & (found[some] > 0) & (sources[some] >= low) & (sources[some] < high))
            values.append(chi(mine[good], q[good]))
            owners.append(np.stack([sources[some][good], rows[good] + at]))
            at = upto
        pairs = np.repeat(np.arange(low, high), n), np.tile(np.arange(n), high - low)
        apart = pairs[0] != pairs[1]
        value, (source, row) = np.concatenate([*values, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros((2, 0), np.int64)], axis=1)
        for s in np.unique(source):  # all terms at or above the last place of this part
            mine = np.flatnonzero(source == s)
            if len(mine) > top:
                mine = mine[value[mine] >= np.partition(value[mine], -top)[-top]]
            best[s] = mine
        chosen = np.concatenate([*best.values(), np.zeros(0, np.int64)])
        terms = stripes["term"].combine_chunks().take(pa.array(row[chosen])) if len(stripes) else pa.array([], pa.string())
        out = [
            pa.concat_arrays([names.take(pa.array(pairs[0][apart])).combine_chunks(), names.take(pa.array(source[chosen])).combine_chunks()]),
            pa.array(["pair"] * int(apart.sum()) + ["term"] * len(chosen), pa.string()),
            pa.concat_arrays([names.take(pa.array(pairs[1][apart])).combine_chunks(), terms]),
            pa.array(np.concatenate([sums.ravel()[apart], value[chosen]]), pa.int64()),
        ]
        lang = pa.array([groups["lang"][0].as_py()] * len(out[0]), pa.string())
        return pa.Table.from_arrays([lang, *out], names=["lang", "source", "part", "item", "value"])

    return emitted


def stripe_divergences(stripes: DataFrame, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` from merged stripes (read several times: a written table).

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` kept terms that a source uses more than
    its language does.
    """
    counts = stripes.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.source", "c.n")
    groups = cut_lineage(counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.when(F.col("term") != "", 1)).alias("held")))
    vocabulary = stripes.where("term != ''").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"))
    langs = langs.join(vocabulary, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("bigint")))
    langs = cut_lineage(langs.withColumns({"parts": F.ceil(F.greatest("held", F.lit(1)) / PART), "panel_rows": F.greatest(F.floor(CELLS / F.col("n")), F.lit(1))}))
    panels = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("panel_rows")))).alias("panel")

    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    placed = cut_lineage(placed)
    salted = placed.join(langs.drop("held"), "lang").select("*", panels).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt"))
    salted = salted.select("lang", "source", "size", "place", "lang_size", "v", "panel", "salt", (F.col("panel") * F.col("panel_rows")).alias("low"), ((F.col("panel") + 1) * F.col("panel_rows")).alias("high"))
    # Names of sources become places by a map of the language, which has no more entries than a panel has columns.
    named = placed.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "place"))).alias("of"))
    dealt = lookup_join(stripes.where("term != ''").select("lang", "term", "counts"), langs.select("lang", "n", "parts", "panel_rows").join(named, "lang"), "lang")
    dealt = dealt.select("lang", "term", panels, F.pmod(F.xxhash64("term"), "parts").alias("salt"), F.transform("counts", lambda c: F.element_at("of", c["source"])).alias("places"), F.transform("counts", lambda c: c["n"]).alias("ns"))
    ship(stripes.sparkSession)
    emitted = dealt.groupBy("lang", "panel", "salt").cogroup(salted.groupBy("lang", "panel", "salt")).applyInArrow(_emit(top), "lang string, source string, part string, item string, value bigint")
    emitted = cut_lineage(emitted)
    pairs = emitted.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = emitted.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """Divergences of all sources of ``docs(text, lang, source)`` within their languages."""
    return stripe_divergences(cut_lineage(term_stripes(docs, least)), top)
