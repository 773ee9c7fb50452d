"""Hot keys, repeated ids and missing labels: what the operators do with rows that gather in one place."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import langid, minhash, mixing

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components_of_rows(docs, size):
    """Components over ids, where one id may stand on rows with several texts."""
    sets = [(d, brute.components([(0, t)], size)[0][0], t) for d, t in docs]
    shingles = [set(zip(*[brute.WORDS.findall(brute.lower(t))[k:] for k in range(size)], strict=False)) for _, _, t in sets]
    parent = {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
                x, y = sorted((top(docs[a][0]), top(docs[b][0])))
                parent[y] = x
    return {d: top(d) for d in parent}


def test_an_id_with_several_texts_loses_no_link(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    docs = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (5, c), (4, b), (7, f"{c} x"), (7, prose(60, 4)), (9, prose(60, 4))]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == components_of_rows(docs, 4) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 5, 9: 5}


@pytest.mark.parametrize("together", [2, 256])
def test_pairs_of_one_head_are_verified_in_parts(spark, monkeypatch, together):
    """A text with a hundred near copies, in parts of two pairs: same components."""
    monkeypatch.setattr(minhash, "TOGETHER", together)
    base = prose(150, 5).split()
    docs = [(0, " ".join(base))]
    for k in range(1, 100):
        copy = list(base)
        copy[k] = f"other{k}"
        docs.append((k, " ".join(copy)))
    docs += [(200 + k, prose(50, 100 + k)) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = minhash.near_duplicates(df, size=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: 0 if d < 100 else d for d, _ in docs}


def test_rows_of_a_capped_source_are_not_ranked(spark, monkeypatch):
    """Sources at their cap have no row in a cut bin; open ones have a bin's rows at most, about."""
    docs = [(k, "w " * 10, "full" if k % 3 else "open") for k in range(9000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = df.select(mixing._narrow(df, "text", "doc_id", "source", None, "mix"))
    seen = {}

    def counted(frame, *columns, join=type(df).groupBy):
        if columns[:2] == ("source", "_cut"):
            seen.update({r["source"]: r["n"] for r in join(frame, "source").agg(F.count(F.lit(1)).alias("n")).collect()})
        return join(frame, *columns)

    monkeypatch.setattr(type(df), "groupBy", counted)
    mixing.mix_plan(rows, (1, 100), 1.5, 2)
    assert "open" not in seen or "full" not in seen  # one of the two is at its cap
    assert all(n < 2 * mixing.BIN_ROWS for n in seen.values()) and len(seen) == 1


def test_texts_stay_where_no_language_can_be_learnt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, None), (-2, "12 34"), (-3, "")], "doc_id bigint, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, both, sf)
    assert kept.columns == docs.columns
    with_letters = both.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    assert kept.count() == with_letters.count() and not kept.where("doc_id < 0").count()


def test_language_margin_is_relative_to_chance(spark):
    """With two languages a text must be over one half, with one language all texts with letters stay."""
    en, de = [prose(30, k) for k in range(40)], [prose(30, k).replace("a", "ü").replace("e", "ö") for k in range(40, 80)]
    rows = [(k, t, "en") for k, t in enumerate(en)] + [(100 + k, t, "de") for k, t in enumerate(de)] + [(300, "!!", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train_language_model(df)
    kept = langid.in_known_language(df, model, 1 / 15)
    told = {r["doc_id"]: r["score"] for r in langid.predict_languages(df, model).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in told.items() if d != 300 and s >= 0.5 + 0.5 / 15}
    assert langid.in_known_language(df, langid.train_language_model(df.where("lang = 'en'")), 1 / 15).count() == 80


def test_long_words_are_learnt_from_any_place(spark):
    """Of a word longer than a window, a window at a random place is in the sample, not its first letters."""
    rows = [(k, "".join(random.Random(k).choices("abcdefgh", k=400)), "en") for k in range(50)]
    words, langs = langid.training_words(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 50, 2)
    assert len(words) == len(langs) == 100 and {len(w) for w in words} == {langid.WINDOW}
    texts = [t for _, t, _ in rows]
    assert all(any(w in t for t in texts) for w in words) and sum(any(t.startswith(w) for t in texts) for w in words) < 20


def test_forward_pass_and_pooling_equal_a_plain_version(spark):
    """The network of language ID, byte by byte in plain Python, against the vectorised pass."""
    rows = [(k, prose(20, k), "en" if k % 2 else "de") for k in range(40)]
    model = langid.train_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), epochs=1)
    import pyarrow as pa

    texts = ["abc de", "a", "hello hello world", "éa üb"]
    got = model.document_labels(pa.chunked_array([texts]))
    wanted = []
    for text in texts:
        sums, n = np.zeros(len(model.languages)), 0
        for word in text.split():
            s, size = model.word_labels(pa.array([word]))
            sums += s[0]
            n += size[0]
        wanted.append(sums / n)
    assert np.allclose(got, np.array(wanted))


NASTY = [
    (1, prose(60, 1), "en", "a"), (1, prose(60, 2), "en", "a"), (2, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \n", None, "b"),
    (6, prose(20000, 3), "en", "c"), (7, "ÄÖ straße x", None, None), (None, prose(60, 9), "en", "a"), (8, "!!! 123", "de", "d"), (9, prose(60, 2) + " end", "de", "a"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_nasty_rows(spark, sf, name):
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    df = df.withColumns({c: F.lit(-7) for c in ("_dropped", "component", "size", "copies", "block", "score", "lang_pred", "_row", "id", "place")})
    out = dict(corpus_pipeline.STAGES)[name](spark, df, sf)
    rows = out.collect()
    if name == "shards":
        assert len(rows) == len(NASTY)
        return
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in rows]
    if name == "language":
        assert sorted(i for i in ids if i is not None) == [1, 1, 2, 2, 6, 7, 9] and None in ids
    if name == "near_duplicates":
        assert sorted({i for i in ids if i is not None}) == [1, 3, 4, 5, 6, 7, 8] and None in ids
    if name == "benchmark":
        assert len(rows) == len(NASTY)
    assert all(r["_dropped"] == -7 for r in rows)
