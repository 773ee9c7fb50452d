"""Every operator against a plain version, on nasty rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import ann, decontam, langid, minhash, mixing, pitman_yor, sharding, suffix_dedup, token_counts, token_files
from tokenizers import Tokenizer

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(40, 99)
NASTY = [
    (1, prose(60, 1), "a"), (2, prose(60, 1), "a"), (2, prose(60, 1), "a"), (3, None, None), (4, "", "b"), (5, "  \n\t ", "b"),
    (6, prose(30000, 2), "c"), (7, "ÄÖÜ straße É́clair  x y naïve", None), (8, "!!! ??? 123", "d"),
    (None, prose(60, 1), "a"), (9, "<|endoftext|> x <|startoftext|>y<|endoftext|>", "b"), (10, "a" * 3000, "b"),
    (11, " two  spaces \n\n new\r\nlines\t\tend it's I'LL ", "a"), (12, prose(25, 3) + " " + PASSAGE, "a"),
    (13, PASSAGE.upper() + " " + prose(30, 4), "c"), (14, "one", "d"), (15, "One", "d"), (16, "x\x00y " + prose(20, 5), "b"),
    (17, prose(60, 1) + " more", "a"), (18, "\x1c \x85   edge ", "c"), (19, PASSAGE[:49], "c"), (20, PASSAGE[:50] + "\U0001f600" * 30, "c"),
]
CLASHING = ("size", "n", "component", "block", "shard", "key", "list", "target", "copies", "bin", "digest", "cell", "place", "hits", "items", "id", "head", "band", "part", "body", "held_out", "score")


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit(-7) for c in CLASHING} | {"lang": F.lit("en")})


@pytest.fixture(scope="module")
def none(nasty):
    return nasty.where("doc_id < 0")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def collected(df, *columns):
    return ordered(tuple(r[c] for c in columns) for r in df.collect())


def test_benchmark_index_equals_plain_search(spark, nasty, none):
    items = [("i1", PASSAGE), ("i2", "one"), (None, PASSAGE), ("i3", None), ("i4", ""), ("i1", PASSAGE), ("i5", prose(13, 2)), ("i6", "nowhere found")]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.contamination(nasty, table)
    rows = ordered((r["doc_id"], r["n_words"], len(r["hits"]), r["items"]) for r in found.collect())
    assert rows == ordered(brute.benchmark_hits([(d, t) for d, t, _ in NASTY], items))
    assert any(n for _, _, n, _ in rows)
    assert decontam.contamination(none, table).count() == 0
    assert all(not r["hits"] for r in decontam.contamination(nasty, table.where("item_id = 'x'")).collect())


def test_benchmark_search_in_batches_and_by_proximity(spark, nasty, monkeypatch):
    items = spark.createDataFrame([(str(k), PASSAGE[k * 7 :]) for k in range(6)], "item_id string, text string")
    columns = ("doc_id", "n_words", "hits", "items")
    whole = collected(decontam.contamination(nasty, items), *columns)
    monkeypatch.setattr(decontam, "BATCH_BYTES", 300)
    assert collected(decontam.contamination(nasty, items), *columns) == whole
    words = PASSAGE.split()
    loose = " ".join(w + " filler" if k == 5 else w for k, w in enumerate(words[:13]))
    docs = spark.createDataFrame([(1, loose), (2, prose(50, 8))], "doc_id bigint, text string")
    index, asked = decontam.build_index(docs), spark.createDataFrame([("p", " ".join(words[:13]))], "item string, text string")
    hits = {s: [len(r["hits"]) for r in decontam.find_items(index, asked, "bigint", slack=s).orderBy("doc_id").collect()] for s in (0, 1)}
    assert hits[0] == [0, 0] and hits[1][0] >= 12 and hits[1][1] == 0


def test_contaminated_documents_go_and_others_stay_as_they_are(spark, nasty):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    kept = decontam.without_contaminated(nasty, items)
    assert kept.columns == nasty.columns
    gone = {d for d, n, h, _ in brute.benchmark_hits([(d, t) for d, t, _ in NASTY], [(1, PASSAGE)]) if h and 20 * h >= n}
    assert gone and collected(kept, "doc_id", "size") == ordered((d, -7) for d, _, _ in NASTY if d not in gone)


def test_passage_dedup_equals_plain_search(nasty, none):
    rows = suffix_dedup.remove_repeats(nasty).collect()
    made = ordered((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
    assert made == ordered(brute.kept_bytes([(d, t) for d, t, _ in NASTY]))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_passage_dedup_over_many_blocks_and_periodic_texts(spark):
    rng = random.Random(5)
    docs = [(k, "ab" * rng.randint(0, 200) + prose(rng.randint(0, 80), rng.randint(0, 30)) + "%" * rng.randint(0, 120)) for k in range(150)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)).collect()
    made = sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
    assert made == sorted(brute.kept_bytes(docs))


def test_passage_dedup_deals_out_the_windows_of_crowded_anchors(spark, monkeypatch):
    line = prose(12, 77)
    docs = [(k, prose(20, 1000 + k) + " " + line + " " + prose(20, 2000 + k // 2)) for k in range(120)] + [(200, prose(200, 9)), (201, prose(200, 9))]
    texts = pa.table({"doc_id": [d for d, _ in docs], "text": pa.chunked_array([[t for _, t in docs]])})
    segments = suffix_dedup.Segments(texts, 50)
    anchors, _, number = segments.anchors()
    crowded = anchors[np.argsort(np.bincount(number))[-2:]]
    windows = int(segments.windows.sum())
    before = set(suffix_dedup._shard(segments.anchor[np.isin(segments.anchor, crowded)], 64))
    mine = segments.scatter(crowded)
    dealt = suffix_dedup._shard(segments.anchor[int((~mine).sum()) :], 64)
    assert len(before) <= 2 and len(set(dealt)) > 8 and int(segments.windows.sum()) == windows
    for most, shard_bytes in ((2000, 1 << 20), (2000, 4000), (0, 4000), (1 << 30, 4000)):
        monkeypatch.setattr(suffix_dedup, "CROWDED", most)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
        rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
        made = sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
        assert made == sorted(brute.kept_bytes(docs))


def test_interval_expansion_finds_all_shared_substrings():
    rng = np.random.default_rng(1)
    for length in (3, 8, 20):
        strings = [bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(30)]
        owners = rng.integers(0, 9, 30)
        sizes = np.array([len(s) for s in strings])
        made = suffix_dedup.smallest_owners(np.frombuffer(b"".join(strings), np.uint8), sizes, owners, length)
        least = {}
        for s, o in zip(strings, owners, strict=True):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(o, least.get(s[i : i + length], o))
        assert made.tolist() == [least[s[i : i + length]] for s in strings for i in range(len(s) - length + 1)]


def test_suffixes_are_sorted_again_only_where_they_tie(monkeypatch):
    rng = np.random.default_rng(2)
    grams = rng.integers(1, 200, (300, 9))
    symbols = np.concatenate([grams[rng.integers(0, 300, 4000)].ravel(), [0], np.tile([5, 6, 7], 40)]).astype(np.uint16)
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: (sizes.append(len(a)), sort(a, *args, **more))[1])
    padded = np.concatenate([symbols, np.zeros(60, np.uint16)])
    for trebled in (suffix_dedup.TREBLED, 0):
        sizes.clear()
        monkeypatch.setattr(suffix_dedup, "TREBLED", trebled)
        order = suffix_dedup.sorted_suffixes(symbols, 50)
        assert sum(sizes) < 2.2 * len(symbols)
        begun = [tuple(padded[k : k + 50]) for k in order]
        assert sorted(order.tolist()) == list(range(len(symbols))) and begun == sorted(begun)


def test_token_counts_equal_the_library(nasty, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    wanted = ordered((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in NASTY)
    assert collected(token_counts.token_counts(nasty, path), "doc_id", "n_bytes", "n_tokens") == wanted
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_of_odd_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, library, model = random.Random(1), Tokenizer.from_file(path), token_counts.ByteBpe(path)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "Bc", "é", "1", "22", "!", "'s", "'ll", "<|endoftext|>", "日本", "aaaa"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert model.count(pa.array(texts)).tolist() == wanted


def test_token_files_equal_the_library(spark, nasty, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write_token_files(nasty, str(tmp_path / "ids"), path)
    files = token_files.read_token_files(spark, str(tmp_path / "ids"))
    made = {}
    for r in files.collect():
        made.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids"]))
    start = 0
    for d, t in sorted(((d, t) for d, t, _ in NASTY), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (start, len(ids), ids) in made[d]
        start += len(ids)
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.token_digests(spark, str(tmp_path / "ids")).collect()}
    assert digest[(1, made[1][0][0])] == zlib.crc32(np.array(made[1][0][2], "<u4").tobytes())
    assert [r["doc_id"] for r in files.where("doc_id = 12").collect()] == [12]
    token_files.write_token_files(none, str(tmp_path / "no"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "no")).count() == 0


def test_near_duplicates_equal_plain_search(spark, nasty, none):
    made = minhash.near_duplicates(nasty, size=4).collect()
    wanted = brute.components([(d, t) for d, t, _ in {(d, t, s) for d, t, s in NASTY} if d is not None], 4)
    assert len(made) == len(NASTY)
    for r in made:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.without_near_duplicates(nasty, size=4)
    assert kept.columns == nasty.columns
    assert collected(kept, "doc_id") == ordered([(None,), *((d,) for d, (_, c) in wanted.items() if c == d)])


def test_near_duplicate_groups_of_every_shape(spark):
    rng = random.Random(11)
    docs, k = [], 0
    for group in range(25):
        words = prose(rng.randint(3, 120), 1000 + group).split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)  # drifts along the group
            docs.append((k, " ".join(words)))
            k += 1
    rng.shuffle(docs)
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    made = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made} == brute.components(docs, 5)


def test_signature_agreement_estimates_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        a, b = base[:2000], base[int(2000 * (1 - share) / (1 + share)) :][:2000]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        made = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((made[:, 0] == made[:, 1]).mean() - true) < 0.14


def test_mixture_meets_targets(spark, nasty, none):
    rows = mixing.mix_sources(nasty).collect()
    assert len(rows) == len(NASTY)
    total = sum(len(brute.WORDS.findall(t or "")) for _, t, _ in NASTY)
    target = {r["source"]: r["target"] for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-9
    assert collected(mixing.mix_sources(nasty), "doc_id", "taken") == ordered((r["doc_id"], r["taken"]) for r in rows)
    mixed = mixing.mixed_documents(nasty)
    assert mixed.columns == nasty.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("bin_rows", [7, 20_000])
def test_mixture_of_many_documents_is_close_and_follows_weights(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rng = random.Random(4)
    docs = [(k, "w " * rng.randint(1, 60), rng.choice("aaaabcde")) for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = mixing.mix_sources(df).collect()
    for source in "abcde":
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 30
    sizes = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in "abcde"}
    weight = dict(zip("abcde", (3, 1, 2, 3, 1), strict=True))
    target, left, goal = {}, set("abcde"), 1.5 * sum(sizes.values())
    while True:  # give out by weight; what exceeds a cap is shared again
        level = (goal - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over}
        left -= over
        if not over:
            break
    target |= {s: level * weight[s] for s in left}
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in rows)
    heavy = mixing.mix_sources(df, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    even = [sum(r["taken"] for r in heavy if r["doc_id"] % 2 == p) / sum(r["size"] for r in heavy if r["doc_id"] % 2 == p) for p in (0, 1)]
    assert even[0] > even[1]


def test_shards_have_the_smallest_capacity(spark, nasty, none):
    rng = random.Random(6)
    more = [(100 + k, prose(rng.randint(0, 50), rng.randint(0, 60)), "a") for k in range(400)]
    for rows, shards in ((NASTY, 3), (NASTY + more, 8), (more[:1], 8), (more, 1)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("cell", F.lit(1))
        placed = sharding.shard_documents(df, shards).collect()
        groups = {}
        for _, t, _ in rows:
            name = hashlib.sha256((t or "").encode()).hexdigest()
            groups[name] = groups.get(name, 0) + len((t or "").encode()) + 1
        best = brute.smallest_capacity([groups[g] for g in sorted(groups)], shards)
        load = [sum(r["size"] for r in placed if r["shard"] == s) for s in range(shards)]
        assert max(load) <= best and sum(load) == sum(groups.values())
        for s in range(shards):
            slots = sorted(r["slot"] for r in placed if r["shard"] == s)
            assert slots == list(range(len(slots)))
        homes = {}
        for r in placed:
            homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(none, 8).count() == 0


def test_shard_plan_is_native(spark, nasty, tmp_path):
    plan = sharding.shard_documents(nasty, 4)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
    sharding.write_shards(nasty, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(NASTY)


def test_language_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    weights = {k: v.astype(np.float64) for k, v in langid.new_weights(4, 3).items()}
    symbols, lengths = rng.integers(97, 101, (6, 9)).astype(np.uint8), np.array([9, 8, 7, 5, 3, 9])
    _, batch, mask = next(langid.batches_of(symbols, lengths, 6))
    target = np.array([0, 1, 2, 0, 1, 2])
    _, slopes = langid.gradients(weights, batch, mask, target)
    for name in weights:
        for spot in [tuple(rng.integers(0, s) for s in weights[name].shape) for _ in range(4)] + ([(97, 1), (98, 5), (99, 9)] if name[0] == "E" else []):
            kept = weights[name][spot]
            losses = []
            for step in (1e-2, -1e-2):
                weights[name][spot] = kept + step
                losses.append(langid.gradients(weights, batch, mask, target)[0])
            weights[name][spot] = kept
            assert abs((losses[0] - losses[1]) / 2e-2 - slopes[name][spot]) < 2e-3


def test_language_of_held_out_texts(spark, sf, nasty, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train_language_model(docs.where(~held_out).select("doc_id", "text", "lang"))
    made = langid.predict_languages(docs, model, keep=(F.col("lang"), held_out.alias("out"))).where("out").collect()
    assert len(made) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in made]) > 0.9
    rows = {r["doc_id"]: r for r in langid.predict_languages(nasty, model).collect()}
    assert all(rows[d]["lang_pred"] == "und" and rows[d]["score"] == 0 for d in (3, 4, 5, 8))
    assert all(r["lang_pred"] in ("en", "de", "fr", "es") and 0 <= r["score"] <= 1 for d, r in rows.items() if d not in (3, 4, 5, 8, 18))
    assert langid.predict_languages(none, model).count() == 0
    unlearnt = langid.train_language_model(none.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict_languages(nasty, unlearnt).collect()} == {"und"}
    kept = langid.in_known_language(nasty, model, 0.0)
    assert kept.columns == nasty.columns and kept.where("doc_id in (3, 4, 5, 8)").count() == 0


def test_table_chances_equal_stirling_numbers():
    discount, chance = 0.8, pitman_yor.alone(0.8)
    numbers = {(1, 1): 1.0}
    for c in range(2, 30):
        for t in range(1, c + 1):
            numbers[c, t] = numbers.get((c - 1, t - 1), 0.0) + (c - 1 - discount * t) * numbers.get((c - 1, t), 0.0)
            assert abs(chance[c, t] - numbers.get((c - 1, t - 1), 0.0) / numbers[c, t]) < 1e-4


def test_gibbs_moves_reach_the_seating_distribution():
    c, d, strength, p = 6, 0.6, 1.5, 0.2
    numbers = {(1, 1): 1.0}
    for n in range(2, c + 1):
        for t in range(1, n + 1):
            numbers[n, t] = numbers.get((n - 1, t - 1), 0.0) + (n - 1 - d * t) * numbers.get((n - 1, t), 0.0)
    wanted = np.array([np.prod([strength + d * i for i in range(1, t)]) * numbers[c, t] * p**t for t in range(1, c + 1)])
    rng, tables = np.random.default_rng(1), np.ones(40_000)
    for _ in range(80):
        tables = pitman_yor.moved(rng, np.full(len(tables), c), tables, np.full(len(tables), p), tables, d, strength, 1)
    made = np.bincount(tables.astype(int), minlength=c + 1)[1:] / len(tables)
    assert np.abs(made - wanted / wanted.sum()).max() < 0.02


def test_table_counts_of_many_customers_are_drawn_from_their_distribution():
    c, d, strength, p, others = 3000, 0.8, 2.0, 0.05, 500.0
    tables = np.arange(1501)
    numbers = np.where(tables == 1, 0.0, -np.inf)
    for n in range(2, c + 1):
        with np.errstate(divide="ignore"):
            stay = numbers + np.log(np.maximum(n - 1 - d * tables, 0))
        numbers = np.logaddexp(stay, np.concatenate([[-np.inf], numbers[:-1]]))
    wanted = numbers[1:] + np.cumsum(np.log((strength + d * (others + tables[:-1])) * p))
    wanted = np.exp(wanted - wanted.max())
    wanted /= wanted.sum()
    made = pitman_yor.drawn(np.random.default_rng(1), np.full(20_000, c), np.full(20_000, p), np.full(20_000, others), d, strength)
    mean = (wanted * tables[1:]).sum()
    spread = np.sqrt((wanted * (tables[1:] - mean) ** 2).sum())
    assert abs(made.mean() - mean) < 0.03 * spread + 0.002 * mean and abs(made.std() / spread - 1) < 0.03


def test_one_sweep_seats_frequent_dishes_anew():
    words, contexts = np.arange(2, dtype=np.uint64), np.array([5, 5], np.uint16)
    shard = pitman_yor.Shard([pitman_yor.pack(words, np.array([1, 1]), contexts, np.array([100_000, 3]))])
    first = shard.totals(*[next(shard.seatings(0, [], 2))[k] for k in (0, 2)])
    total = first.copy()
    total[shard.context[0]], total[-2], total[-1] = 200_000, 20, 10
    tables = list(shard.seatings(0, [total], 2))[-1][0]
    # A customer leaves as often alone as one opens a table, by the update rule of a single customer.
    t, base = tables[0], pitman_yor.root_probability(np.ones(1), np.ones(1), total, 2)[0]
    fresh = (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * (200_000 - 2 + t)) * base
    enters = fresh / (fresh + 99_999 - pitman_yor.DISCOUNT * t)
    leaves = np.exp(pitman_yor.log_alone(np.array([100_000]), np.array([int(t)]), pitman_yor.DISCOUNT))[0]
    assert t > 1000 and abs(enters / leaves - 1) < 0.1


def test_scores_against_plain_base_and_better_than_it(spark, nasty, none):
    docs = [(k, prose(80, 500 + k // 3)) for k in range(120)] + [(d, t) for d, t, _ in NASTY if d is not None]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(5)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    tokens = [(d, [*brute.WORDS.findall(brute.lower(t)), None], zlib.crc32(str(d).encode()) % 10 == 0) for d, t in docs]
    counts = {}
    for _, words, held in tokens:
        for w in words if not held else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    wanted = ordered((d, held, len(w), sum(x in counts for x in w), n, round(float(sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)), 5)) for d, w, held in tokens)
    rows = pitman_yor.score_texts(df, out).collect()
    assert ordered((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == wanted
    assert all(r["score"] < 0 for r in rows)
    copies = [r for r in rows if r["held_out"] and 20 < r["doc_id"] < 120]  # of texts that were learnt
    assert copies and sum(r["score"] for r in copies) > 0.85 * sum(r["base_score"] for r in copies)
    assert pitman_yor.score_texts(none, F.lit(False)).count() == 0
    assert pitman_yor.score_texts(nasty, F.lit(True)).count() == len(NASTY)
    assert pitman_yor.perplexity(pitman_yor.score_texts(df, out)).count() == 2


def test_predictive_probabilities_sum_to_one():
    texts = pa.chunked_array([[prose(200, 1), prose(150, 2), None]])
    tokens = pitman_yor.Tokens(texts)
    counts = np.bincount(tokens.cell)
    body = pitman_yor.pack(tokens.words, np.diff(tokens.starts), tokens.context_of, counts)
    shard = pitman_yor.Shard([body])
    vocabulary = len(shard.words)
    totals = []
    for _ in range(3):
        tables, customers, root = list(shard.seatings(0, totals, vocabulary))[-1]
        totals.append(shard.totals(tables, root))
    parent = pitman_yor.root_probability(customers, root, totals[-1], vocabulary)
    unknown = pitman_yor.root_probability(np.zeros(1), np.zeros(1), totals[-1], vocabulary)
    assert abs(parent.sum() + unknown[0] - 1) < 1e-9
    context = int(shard.context[0])
    mine = shard.context == context
    spare = pitman_yor.STRENGTH + pitman_yor.DISCOUNT * totals[-1][context]
    seated = (shard.counts[mine] - pitman_yor.DISCOUNT * tables[mine]).sum()
    assert abs((seated + spare) / (pitman_yor.STRENGTH + shard.counts[mine].sum()) - 1) < 1e-9


def test_contexts_follow_from_words_without_a_sort_of_their_own(monkeypatch):
    texts = [" ".join(f"w{k % 7 * i}" for k in range(i)) for i in range(1, 60)] + ["", None, "A a b", "b"]
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda a, *args, **more: (sizes.append(len(a)), unique(a, *args, **more))[1])
    tokens = pitman_yor.Tokens(pa.chunked_array([texts]))
    assert sizes == [int(tokens.counts.sum())]
    word = tokens.words[tokens.word_of[tokens.cell]]
    before = np.concatenate([[pitman_yor.START], word[:-1]])
    before[tokens.ends - tokens.counts] = pitman_yor.START
    assert (tokens.words == unique(word)).all() and (tokens.contexts == unique(before)).all()
    assert (tokens.context_of[tokens.cell] == before).all() and (word[tokens.ends - 1] == pitman_yor.END).all()


def test_every_word_is_a_context_of_its_own(spark, monkeypatch):
    words = [f"w{k}" for k in range(6000)]
    assert len(np.unique(pitman_yor.Tokens(pa.chunked_array([[" ".join(words)]])).context_of)) == 6001
    monkeypatch.setattr(pitman_yor, "SHARD_BYTES", 4000)
    docs = [(k, " ".join(words[100 * k : 100 * k + 100]) + " common pair") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    model = pitman_yor.Model(df.select("text"))
    contexts, tables = {}, []
    for rows in model.tables:
        for row in rows.collect():
            if row["shard"] >= model.shard_count and row["block"] == pitman_yor.STORED:
                names, counts = pitman_yor.unpack(row["body"])
                contexts |= dict(zip(np.cumsum(names).tolist(), counts.tolist(), strict=True))
            elif row["shard"] >= model.shard_count:
                tables.append((row["block"], int(pitman_yor.unpack(row["body"])[0].sum())))
    assert model.shard_count > 5 and sorted(contexts.values()) == [1] * 6000 + [60] * 3  # common, pair, start of a text
    sums = [sum(n for b, n in tables if b == block) for block in sorted({b for b, _ in tables}, reverse=True)]
    assert sums == [int(s[0]) for s in model.sums] and len(sums) == pitman_yor.SAMPLES
    rows = model.score(df, ["doc_id"]).collect()
    assert len(rows) == 60 and all(r["n_known"] == r["n_tokens"] == 103 and r["score"] > r["base_score"] for r in rows)


def test_scan_of_many_queries_together(monkeypatch):
    rng = np.random.default_rng(4)
    rows, queries = rng.normal(size=(400, 40)), rng.normal(size=(90, 40))
    rows[250:], queries[:30] = rows[250], rows[240:270]
    blocks, wanted = [rows.T[d : d + 16] for d in range(0, 40, 16)], rng.integers(3, 40, 90)
    square = ((queries[:, None] - rows) ** 2).sum(axis=2)
    seeds = np.maximum(4 * wanted, 64)
    bound = np.array([np.sort(square[i, : seeds[i]])[wanted[i] - 1] for i in range(90)])

    def pairs():
        return [(i, r) for part in ann.scan(blocks, queries, wanted) for i, r in zip(*(x.tolist() for x in part), strict=True)]

    once = pairs()
    assert len(list(ann.scan(blocks, queries, wanted))) == 1  # all queries in one product of matrices
    assert once == sorted(set(once)) and all(square[i, r] <= bound[i] * (1 + 1e-5) + 1e-9 for i, r in once)
    assert {(i, r) for i in range(90) for r in np.flatnonzero(square[i, : seeds[i]] <= bound[i])} <= set(once)
    monkeypatch.setattr(ann, "TOGETHER", 900)
    assert pairs() == once
    monkeypatch.setattr(ann, "FEW", 1)
    assert pairs() == once
    monkeypatch.setattr(ann, "EPSILON", 1e6)  # nothing is given up before its whole distance is known
    assert set(pairs()) >= {(i, r) for i in range(90) for r in np.flatnonzero(square[i] <= bound[i])}


def test_nearest_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    vectors[300:700] = vectors[300]  # a third are one vector
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] * 24), (5080, [None] * 24), (5100, [1.0] * 3), (20, vectors[20].tolist()), (None, vectors[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("list", F.lit(3))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "PART_ROWS", 7)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 1500, 20))
    everyone = np.concatenate([vectors, vectors[20:21], vectors[1:2]])
    ids = np.array([*range(1500), 20, 10**6])
    shares = []
    for query, rows_ in found.items():
        assert [r for r, _, _ in rows_] == list(range(1, 21)) and all(v != query for _, v, _ in rows_)
        score = (everyone * vectors[query]).sum(axis=1)
        score[ids == query] = -np.inf
        assert [s for _, _, s in rows_] == sorted((s for _, _, s in rows_), reverse=True)
        best = [int(ids[i]) for i in np.lexsort((ids, -score))[:20]]
        shares.append(len({10**6 if v is None else v for _, v, _ in rows_} & set(best)) / 20)
    assert np.mean(shares) >= 0.9
    few = ann.nearest(df.where("vec_id < 9"), F.col("vec_id") == 0, k=20)
    assert few.count() == 8
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0
