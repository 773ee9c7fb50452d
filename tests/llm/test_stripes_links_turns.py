"""Source divergence, vector links and conversation repair against plain versions, on nasty rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import divergence, turns, vector_links

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(docs, least, top):
    """Rows by the contract, one term and pair at a time, in Python's whole numbers."""
    rows = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""), lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(TERMS.findall(t), s) for t, g, s in rows if g == lang]
        held = collections.Counter(w for words, _ in mine for w in set(words))
        kept = [w for w, n in held.items() if n >= least]
        sources = sorted({s for _, s in mine})
        counts = {s: collections.Counter(w for words, x in mine if x == s for w in words if held[w] >= least) for s in sources}
        whole = sum(counts.values(), collections.Counter())

        def share(c, kept=kept):
            total = sum(c.values()) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q = {s: share(counts[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in sources if t != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def source_docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    docs = [(" ".join(rng.choice(words[: 10 + 5 * (k % 9)]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "en", "de", None]), f"s{rng.randint(0, 5)}") for k in range(300)]
    docs += [(None, "en", "quiet"), ("", "en", None), ("123 !? \x00", None, None), ("İ ǅ Ünï ÀB ab Ab", "en", "s1"), ("only", "fr", "x"), ("only twice", "fr", "x"), ("ab " * 9000, "en", "s0")]
    docs += [("tie one two", "tied", "a")] * 4 + [("tie one two", "tied", "b")] * 4 + [("big", "solo", "s")] * 3
    return docs


def divergence_rows(spark, docs, **limits):
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "df", "n", "place", "counts", "rank", "panel", "value")})
    return sorted(tuple(r) for r in divergence.source_divergence(df, **limits).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_plain_version(spark):
    docs = source_docs()
    assert divergence_rows(spark, docs, least=3, top=7) == plain_divergence(docs, 3, 7)


def test_divergence_with_spills_parts_and_panels(spark, monkeypatch):
    """Small bounds: stripes spill, a language has many parts, pairs of sources several panels, texts several pieces."""
    for name, value in (("HELD", 50), ("PART", 40), ("CELLS", 14), ("PIECE", 64)):
        monkeypatch.setattr(divergence, name, value)
    docs = source_docs()
    batch = pa.RecordBatch.from_arrays([pa.array([d[1] or "" for d in docs]), pa.array([d[2] or "" for d in docs]), pa.array([(d[0] or "").encode() for d in docs])], ["lang", "source", "text"])
    assert len(list(divergence._fold([batch]))) > 20
    assert divergence_rows(spark, docs, least=3, top=7) == plain_divergence(docs, 3, 7)


def test_emitted_parts_under_small_bounds(monkeypatch):
    """The emitting step itself, in panels of two sources and steps of a few counts."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (30, 5)) * (rng.random((30, 5)) < 0.5)
    held = [np.flatnonzero(c) for c in counts]
    stripes = pa.table({"term": [f"t{k:02}" for k in range(30)], "places": pa.array([h.tolist() for h in held], pa.list_(pa.int64())), "ns": pa.array([counts[k][h].tolist() for k, h in enumerate(held)], pa.list_(pa.int64()))})
    groups = {"lang": ["g"] * 5, "source": list("abcde"), "size": counts.sum(0), "place": range(5), "lang_size": [int(counts.sum())] * 5, "v": [30] * 5}

    def run(cells, low, high):
        monkeypatch.setattr(divergence, "CELLS", cells)
        table = divergence._emit(3)(stripes, pa.table(groups | {"low": [low] * 5, "high": [high] * 5}))
        return {tuple(r.values()) for r in table.to_pylist() if r["part"] == "pair"}

    whole = run(1 << 20, 0, 5)
    assert whole == run(10, 0, 2) | run(10, 2, 4) | run(10, 4, 6) and len(whole) == 20


def test_divergence_shares_are_exact():
    counts, totals = np.array([0, 1, 10**15 - 2, 5 * 10**14]), np.array([9 * 10**15, 3, 10**15 - 1, 8 * 10**15 + 7])
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_divergence_of_an_empty_table(spark):
    assert divergence_rows(spark, [("a", "en", "s")][:0], least=3, top=7) == []


def plain_links(rows, threshold):
    vectors = []
    for k, (i, v, label) in enumerate(rows):
        fits = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append((k, i, np.array(v, float) / np.abs(np.array(v, float)).max() if fits else None, label))
    links, near = collections.Counter(), collections.defaultdict(set)
    for a, b in itertools.combinations(vectors, 2):
        if a[2] is None or b[2] is None or a[3] != b[3] or len(a[2]) != len(b[2]):
            continue
        if a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= threshold:
            links[a[0]] += 1
            links[b[0]] += 1
            near[a[1]].add(b[1])
            near[b[1]].add(a[1])
    out = []
    for k, i, _, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((i, links[k], min(seen, key=lambda x: (x is None, x))))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def nasty_vectors():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=20)
            for _ in range(rng.integers(1, 14)):
                rows.append((k, (centre + rng.normal(size=20) * rng.choice([0.0, 0.05, 0.2, 0.3])).astype(np.float32).tolist(), label))
                k += 1
    same = rows[0][1]
    rows += [(k + j, same, 0) for j in range(40)]
    rows += [(k + 50, [x * 3 for x in same], 0), (k + 51, [-x for x in same], 0), (k + 52, same, None), (k + 53, same, 7), (None, same, 0), (k + 54, None, 0)]
    rows += [(k + 55, [0.0] * 20, 0), (k + 56, [float("nan")] + same[1:], 0), (k + 57, [float("inf")] + same[1:], 0), (k + 58, [None] + same[1:], 0), (k + 59, [], 0)]
    rows += [(k + 60, [1.0, 2.0], 0), (k + 61, [1.0, 2.1], 0), (k + 62, [1e-30, 2e-30], 0), (k + 63, [-0.0, 1.0], 0), (k + 64, [0.0, 1.0], 0), (k + 65, [5.0], 1), (k + 66, [2.0], 1)]
    # Repeated rows, and one id with two vectors that joins two groups.
    rows += [rows[20], rows[20], (rows[30][0], rows[100][1], rows[100][2])]
    return rows


def links_of(spark, rows, threshold=0.98):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(-3) for c in ("name", "copies", "tile", "cell", "lead", "size", "vector", "node", "component", "links", "least")})
    return sorted((tuple(r) for r in vector_links.vector_links(df, threshold).select("vec_id", "n_links", "component_id").collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_links_equal_all_pairs(spark, threshold):
    assert links_of(spark, nasty_vectors(), threshold) == plain_links(nasty_vectors(), threshold)


def test_links_over_many_small_tiles(spark, monkeypatch):
    """Tiles of five rows, strips of two and blocks of three dimensions, and a rotation fitted on six vectors."""
    for name, value in (("TILE", 5), ("STRIP", 2), ("BLOCK", 3), ("SAMPLE", 6)):
        monkeypatch.setattr(vector_links, name, value)
    assert links_of(spark, nasty_vectors()) == plain_links(nasty_vectors(), 0.98)


def test_links_of_an_empty_table(spark):
    assert links_of(spark, nasty_vectors()[:0]) == []


def test_strips_stop_early_and_lose_nothing():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 32)) * np.linspace(3, 0.1, 32)
    x[100:] = x[:100] + rng.normal(size=(100, 32)) * 0.02
    table = pa.table({"vector": pa.array(x.tolist(), pa.list_(pa.float64())), "copies": [1] * 200, "vec_id": range(200)})
    units = vector_links.unit_vectors(x)
    axes = {32: np.linalg.eigh(units.T @ units)[1][:, ::-1]}
    side = vector_links.Side(table, axes)
    p, q = vector_links.linked(side, (0, 200), side, (0, 200), 0.98)
    wanted = np.argwhere(units @ units.T >= 0.98)
    assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == sorted(map(tuple, wanted.tolist())) and len(p) > 300
    # Suffix norms bound what is left of a product.
    left = side.turned[:, 16:] @ side.turned[:, 16:].T
    assert (np.abs(left) <= np.outer(side.rest[:, 1], side.rest[:, 1]) + 1e-12).all()


def damaged(rows):
    """Rows after the rule of damage, in order, by conversation."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def plain_repair(mine):
    """Cheapest audit by a forward program over (cost, audit, repaired) of each state; every edit tried."""
    blank = duplicate = truncated = illegal = 0
    seen, kinds = set(), []
    for _, role, text in mine:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    blank, duplicate, truncated = (kinds.count(k) for k in ("blank", "duplicate", "truncated"))
    initials = [r[1][:1] for r in mine]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    given = {"u": "user", "a": "assistant"}

    def inserted(states):
        todo = dict(states)
        for _ in range(3):
            for at, (cost, audit, said) in list(todo.items()):
                for to, role in given.items():
                    if (at, to) in step:
                        new = (cost + 3, audit + "I", [*said, f"{role}:"])
                        todo[to] = min(todo.get(to, new), new)
        return todo

    states = {"": (0, "", [])}
    for (_, role, text), kind in zip(mine, kinds, strict=True):
        following = {}
        for at, (cost, audit, said) in inserted(states).items():
            options = [(at, cost + 4, "D", [])]
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                if (at, role[:1]) in step:
                    options.append((role[:1], cost + more, "K", [f"{role}:{text}"]))
                options += [(to, cost + more + 3, "R", [f"{given[to]}:{text}"]) for to in given if (at, to) in step]
            for to, spent, letter, new in options:
                following[to] = min(x for x in (following.get(to), (spent, audit + letter, said + new)) if x)
        states = following
    cost, audit, said = min(v for k, v in inserted(states).items() if k in ("", "a"))
    known = [r[0] for r in mine if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def conversations():
    rng = random.Random(12)
    texts = ["Well.", "So?", "half", " ", "", "Yes!\n", "yes", "Aé …", "No. "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", ""]), rng.choice(texts) + rng.choice(["", str(turn)])))
    rows += [(100, t, rng.choice(["user", "assistant", "system"]), rng.choice(texts) + str(rng.randint(0, 40))) for t in range(700)]
    rows += [(None, None, None, None), (None, 1, "user", "Hm."), (None, 2, None, "What?"), (200, None, "user", None), (200, None, "user", "a."), (200, 3, "assistant", "b.")]
    rows += [(300, 0, "user", "same."), (300, 0, "user", "same."), (301, 0, "assistant", "x" * 50000 + "!")]
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("kind", "at", "block", "run", "state", "digest", "audit", "what", "n", "copy")})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in turns.repair(turns.damage(df), df.select("conv_id")).collect()}


def test_repair_equals_plain_version(spark):
    rows = conversations()
    wanted = {conv: plain_repair(mine) for conv, mine in damaged(rows).items()}
    assert repaired(spark, rows) == wanted


def test_repair_in_blocks_of_four_rows(spark, monkeypatch):
    """One conversation in nearly two hundred runs: matrices are chained and states handed on."""
    monkeypatch.setattr(turns, "LEAST_BLOCK", 4)
    rows = [r for r in conversations() if r[0] is None or r[0] > 40]
    assert repaired(spark, rows) == {conv: plain_repair(mine) for conv, mine in damaged(rows).items()}


def test_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark, [(gone, 0, "user", "x."), (gone, 0, "user", "x.")]) == {gone: empty}
    assert repaired(spark, []) == {}


def test_repaired_turns_are_the_hashed_ones(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 30]
    df = turns.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    said = collections.defaultdict(list)
    for r in turns.repaired_turns(df).orderBy("conv_id", "place").collect():
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in turns.repair(df).collect()}
    assert {c: hashlib.sha256("\n".join(said[c]).encode()).hexdigest() for c in digests} == digests
    for mine in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in mine))


def test_checkpointed_walk_is_least_of_all_audits():
    """Every audit of short runs by brute force: least cost first, then least in ASCII."""
    program, rng = turns.Program(), random.Random(1)
    for _ in range(60):
        kinds = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(1, 5)))
        audit, state, cost = program.edits(kinds, turns.START, turns.FINAL)
        found = (cost + turns.FINAL[state], audit + "I" * (turns.FINAL[state] // turns.INSERT))
        best = None

        def tried(k, at, cost, audit, kinds=kinds):
            nonlocal best
            if best is not None and cost > best[0]:
                return
            if k == len(kinds) and at in (turns.START, turns.ASSISTANT):
                best = min(best or (cost, audit), (cost, audit))
            if len(audit) < 3 * len(kinds) + 3:
                tried(k, turns._GIVEN[at], cost + 3, audit + "I")
            if k < len(kinds):
                for more, letter, to in program._taken(kinds[k], (0, 0, 0, 0), at):
                    tried(k + 1, to, cost + more, audit + letter)

        tried(0, turns.START, 0, "")
        assert found == best
