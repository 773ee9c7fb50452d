"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy.

A sequence is one white-space word with a space before and behind it (words beyond ``WINDOW`` bytes are read in windows).
Two gated recurrent layers read its bytes, one from either side; a softmax over both states labels every byte, and a
document's probabilities are the mean of its labels over all bytes of all its words. Training is backpropagation through
time with Adam, on the driver, over a bounded sample: ``docs_per_language`` documents of each language, the first by a
hash of the id, and ``words_per_doc`` words from hashed places of each whole text.

How it scales: prediction has no shuffle and covers whole texts. Equal words of a chunk of texts share one run of the
network, in batches of words of like length. The weights, some ten kilobytes, travel with the function. Rows are found for
training by one count per language and a hash threshold, so that only about twice the sample is ordered.

Defined results: a text that is null or holds no letter is ``und`` with score 0; without any labelled row everything is
``und``; ties go to the language that is first by code point; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship
from tidemark.llm.packed import chunks, text_buffer

WINDOW = 48
BATCH = 1024
#: Windows that are filled at once.
PLACED = 8192
Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def new_weights(hidden: int, labels: int, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    out: Weights = {}
    for side in ("f", "b"):
        out[f"E{side}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        out[f"U{side}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        out[f"V{side}"] = rng.normal(0, hidden**-0.5, (labels, hidden)).astype(np.float32)
    out["c"] = np.zeros((labels, 1), np.float32)
    return out


def _read(w: Weights, side: str, symbols: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, hidden, batch) of one direction; with ``keep`` what backpropagation needs."""
    steps, batch = symbols.shape
    hidden = w["U" + side].shape[1]
    table, inner = np.ascontiguousarray(w["E" + side].T), w["U" + side]
    states, trace = np.zeros((steps, hidden, batch), np.float32), []
    h = np.zeros((hidden, batch), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        fed = np.take(table, symbols[t], axis=1)
        back = inner @ h
        gates = fed[: 2 * hidden]
        gates += back[: 2 * hidden]
        sigmoid(gates)
        z, r = gates[:hidden], gates[hidden:]
        new = fed[2 * hidden :]
        new += r * back[2 * hidden :]
        np.tanh(new, out=new)
        if keep:
            trace.append((t, h, z, r, new, back[2 * hidden :]))
        after = h - new
        after *= z
        after += new
        if not mask[t].all():
            after *= mask[t]
        states[t] = h = after
    return states, trace


def labels_of(w: Weights, symbols: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probabilities (time, label, batch) of every position."""
    score = w["c"] + np.matmul(w["Vf"], _read(w, "f", symbols, mask, False)[0])
    score += np.matmul(w["Vb"], _read(w, "b", symbols, mask, False)[0])
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score


def gradients(w: Weights, symbols: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy per position and its gradients, by backpropagation through time."""
    hidden = w["Uf"].shape[1]
    runs = {side: _read(w, side, symbols, mask, True) for side in "fb"}
    score = w["c"] + np.matmul(w["Vf"], runs["f"][0]) + np.matmul(w["Vb"], runs["b"][0])
    score -= score.max(axis=1, keepdims=True)
    prob = np.exp(score)
    prob /= prob.sum(axis=1, keepdims=True)
    count = mask.sum()
    batch = np.arange(symbols.shape[1])
    loss = -float((np.log(prob[:, target, batch] + 1e-9) * mask).sum() / count)
    error = prob
    error[:, target, batch] -= 1
    error *= mask[:, None, :] / count
    out: Weights = {"c": error.sum(axis=(0, 2))[:, None]}
    for side in "fb":
        states, trace = runs[side]
        out["V" + side] = np.einsum("tlb,thb->lh", error, states, optimize=True)
        from_labels = np.matmul(w["V" + side].T, error)
        g_table, g_inner = np.zeros_like(w["E" + side]), np.zeros_like(w["U" + side])
        ahead = np.zeros((hidden, symbols.shape[1]), np.float32)
        for t, h, z, r, new, back in reversed(trace):
            g = (from_labels[t] + ahead) * mask[t]
            g_new = g * (1 - z) * (1 - new * new)
            g_z = g * (h - new) * z * (1 - z)
            g_r = g_new * back * r * (1 - r)
            fed = np.concatenate([g_z, g_r, g_new])
            through = np.concatenate([g_z, g_r, g_new * r])
            np.add.at(g_table, symbols[t], fed.T)
            g_inner += through @ h.T
            ahead = w["U" + side].T @ through + g * z
        out["E" + side], out["U" + side] = g_table, g_inner
    return loss, out


def batches_of(words: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers, symbols (time, batch) and mask of batches of words of like length; ``words`` is padded with spaces."""
    order = np.argsort(lengths, kind="stable")
    for k in range(0, len(order), size):
        chosen = order[k : k + size]
        steps = int(lengths[chosen[-1]])
        yield chosen, np.ascontiguousarray(words[chosen, :steps].T), (np.arange(steps)[:, None] < lengths[chosen]).astype(np.float32)


def windows(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded byte windows of words with a space on either side, their lengths, and the word each belongs to."""
    data, offsets = text_buffer(strings)
    sizes = np.diff(offsets)
    parts = np.maximum(1, -(-sizes // (WINDOW - 2)))
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[owner] + nth * (WINDOW - 2)
    size = np.minimum(WINDOW - 2, offsets[owner + 1] - start)
    out = np.full((len(owner), WINDOW), 0x20, np.uint8)
    if len(data):
        spots = np.arange(WINDOW - 2)[None, :]
        for a in range(0, len(owner), PLACED):  # an index of a window has eight times its bytes
            inside = spots < size[a : a + PLACED, None]
            out[a : a + PLACED, 1:-1][inside] = data[(start[a : a + PLACED, None] + spots)[inside]]
    return out, size + 2, owner


class LanguageModel:
    """Trained weights and the languages they tell apart."""

    def __init__(self, languages: list[str], weights: Weights) -> None:
        self.languages, self.weights = languages, weights

    @classmethod
    def train(cls, words: list[str], languages: list[str], hidden: int = 10, epochs: int = 4, size: int = 128, rate: float = 0.02, seed: int = 7) -> LanguageModel:
        names = sorted(set(languages))
        symbols, lengths, owner = windows(pa.array(words, pa.large_string()))
        target = np.searchsorted(names, languages)[owner] if names else np.zeros(0, int)
        weights = new_weights(hidden, max(1, len(names)), seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs if len(names) > 1 else 0):
            groups = list(batches_of(symbols, lengths, size))
            for k in rng.permutation(len(groups)):
                chosen, batch, mask = groups[k]
                _, slopes = gradients(weights, batch, mask, target[chosen])
                step += 1
                for name, g in slopes.items():
                    mean, square = moments[name]
                    mean += 0.1 * (g - mean)
                    square += 0.001 * (g * g - square)
                    weights[name] -= rate * 0.5**epoch * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
        return cls(names, weights)

    def word_labels(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed probabilities (word, label) over the positions of every word, and its number of positions."""
        symbols, lengths, owner = windows(strings)
        sums = np.zeros((len(lengths), max(1, len(self.languages))), np.float64)
        for chosen, batch, mask in batches_of(symbols, lengths, BATCH):
            sums[chosen] = (labels_of(self.weights, batch, mask) * mask[:, None, :]).sum(axis=0).T
        total = np.zeros((len(strings), sums.shape[1]))
        np.add.at(total, owner, sums)
        return total, np.bincount(owner, weights=lengths, minlength=len(strings))

    def document_labels(self, column: pa.ChunkedArray) -> np.ndarray:
        """Mean probabilities (document, label) over all bytes of all words."""
        cut = pc.ascii_split_whitespace(pc.fill_null(column.combine_chunks().cast(pa.large_string()), ""))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        where = coded.indices.to_numpy(zero_copy_only=False)
        sums, sizes = self.word_labels(coded.dictionary)
        owner = np.repeat(np.arange(len(cut)), np.diff(offsets))
        out = np.stack([np.bincount(owner, weights=sums[where, k], minlength=len(cut)) for k in range(sums.shape[1])], axis=1)
        return out / np.maximum(1, np.bincount(owner, weights=sizes[where], minlength=len(cut)))[:, None]


def training_words(labelled: DataFrame, docs_per_language: int, words_per_doc: int) -> tuple[list[str], list[str]]:
    """A bounded sample of words and their languages from rows ``doc_id, text, lang``."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.withColumn("_hash", F.xxhash64(F.lit("train"), "doc_id"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).collect()
    if not counts:
        return [], []
    # About 1.5 times the documents wanted, plus a margin for chance, pass the threshold and are ordered.
    wanted = 1.5 * docs_per_language + 30
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, wanted / row["_n"]))).otherwise(share)
    near = labelled.where(F.pmod("_hash", F.lit(1 << 30)) <= share * float(1 << 30))
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))).where(F.col("_k") <= docs_per_language)
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    spots = F.transform(F.sequence(F.lit(1), F.lit(words_per_doc)), lambda k: F.element_at(F.col("_words"), (F.pmod(F.xxhash64("_hash", k), F.size("_words")) + 1).cast("int")))
    rows = first.withColumn("_words", F.filter(words, lambda w: w != "")).where(F.size("_words") > 0).select("lang", F.explode(spots).alias("word"), "_hash")
    # Of a word beyond a window, one window at a random place is learnt.
    begin = 1 + F.pmod(F.xxhash64("_hash", "word"), F.greatest(F.length("word") - WINDOW + 1, F.lit(1))).cast("int")
    rows = rows.select("lang", F.substring("word", begin, F.lit(WINDOW)).alias("word")).orderBy("lang", "word").collect()
    return [r["word"] for r in rows], [r["lang"] for r in rows]


def train_language_model(labelled: DataFrame, *, docs_per_language: int = 400, words_per_doc: int = 40, hidden: int = 10, epochs: int = 4) -> LanguageModel:
    """Train on a sample of at most ``docs_per_language * words_per_doc`` words of each language."""
    return LanguageModel.train(*training_words(labelled, docs_per_language, words_per_doc), hidden=hidden, epochs=epochs)


def predict_languages(docs: DataFrame, model: LanguageModel, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of whole texts, and the columns in ``keep``."""
    ship(docs.sparkSession)
    languages, weights = model.languages, model.weights
    body = F.col(text)
    has_letter = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.when(has_letter, body).alias("text"), has_letter.alias("_letter"), *keep)
    kept = [f for f in narrow.schema.fields if f.name not in ("text", "_letter")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = LanguageModel(languages, weights)
        for table in chunks(batches):
            prob = trained.document_labels(table["text"])
            best = prob.argmax(axis=1)
            known = table["_letter"].to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            names = np.array([*languages, "und"], object)[np.where(known, best, len(languages))]
            score = np.where(known, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            columns = {f.name: table[f.name] for f in kept}
            yield from pa.table(columns | {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score)}).to_batches()

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(predicted, schema)


def in_known_language(docs: DataFrame, model: LanguageModel, margin: float, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, whose text has a language: its probability is at least chance, one over the number of
    learnt languages, and ``margin`` of what is left to 1. Where fewer than two languages are learnt, all texts with letters stay."""
    n = len(model.languages)
    if n < 2:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    told = predict_languages(docs, model, text=text, doc_id=doc_id, keep=(row,))
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= 1 / n + margin * (1 - 1 / n)))
    return kept.select([F.col("_row").getField(c).alias(c) for c in docs.columns])
