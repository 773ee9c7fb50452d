"""Repair of conversation structure: the cheapest edits that make the roles alternate, by a checkpointed dynamic program.

``repair`` takes the rows of conversations in order of ``turn`` (nulls first; equal turns by role, then the text's SHA-256) and finds for
each conversation the cheapest edits after which the initials of its roles read ``(s?(ua)+)?``: Keep (0), Rerole to user or
assistant (3), Delete (4; required for blank and duplicate rows), Insert an empty text of user or assistant (3); a truncated
row that stays adds 3. Of the cheapest audits the ASCII-least is emitted. ``damage`` is the rule that breaks well-formed rows.

The program has four states (nothing yet, after system, after user, after assistant). A backward pass over a run of rows keeps
the vector of costs to the end only at checkpoints, one for about the square root of the run's rows; the forward walk
recomputes the vectors of one block at a time from its checkpoint, and takes at each step the ASCII-least edit that is tight, that
is, whose cost and cost to the end add up to the present one. Vectors differ from their least entry by small numbers only, so steps
are looked up in a table of (row kind, vector) that fills as it goes.

How it scales: rows are described in a few bytes (digest of role and text, initial, fault) and sorted by range over
(conversation, turn, ...), so a conversation with a third of all rows lies in many tasks. Their places in that order are cut into
blocks of about the square root of all rows. A run of rows between two blocks' edges is one conversation's share of a
block; runs that touch an edge send a 4 x 4 (min, +) matrix of their costs, the matrices of a conversation (no more than the
square root of all rows) are chained backward to give the vector at each run's end and forward to give the state at its
start, and only then are the runs walked, each by itself. Duplicates are found by the least place of each (conversation,
digest), an aggregate that is combined before the shuffle, so a text that repeats a million times is no hot key. Texts are
moved once, to be hashed: one conversation's digest is a chain of its own bytes, so a stream, never a list, of its rows goes
through one task.

Defined results: nulls of id, turn, role and text read as one space in the rule of damage and in roles and texts (a null text
is thus blank, a null role illegal); a null id is a conversation of its own; rows of one conversation with equal turn, role
and text are repeats; an empty role has no initial and is illegal; upper-case initials are illegal; conversations
without rows have zeros, an empty audit and the digest of nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import ship
from tidemark.llm.packed import give_back
from tidemark.session import cut_lineage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Least rows of a block; larger tables have blocks of about the square root of their rows.
LEAST_BLOCK = 4096
#: A cost that no edits have.
NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant; the role that an insertion or rerole gives, and where a kept row leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_GIVEN = (USER, USER, ASSISTANT, USER)
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
#: Costs after the last row: the turns still to be inserted.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Names of the roles that edits give.
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Order of a conversation's rows; nulls first.
ORDER = ("conv_id", "turn", "role", "digest")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the fixed rule: by crc32 of ``conv_id:turn``, a twentieth of the turns each is dropped,
    emptied, loses its sentence ends, is repeated, or becomes the user's."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), said["role"].alias("role"), said["text"].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")



class Program:
    """Steps of the dynamic program, looked up by (row kind, costs after the row)."""

    def __init__(self) -> None:
        self._back: dict[tuple, tuple] = {}
        self._walk: dict[tuple, tuple] = {}

    def back(self, kind: str, after: tuple) -> tuple[int, tuple]:
        """Least entry of the costs before the row, less that of ``after``; and the costs less their least entry."""
        found = self._back.get((kind, after))
        if found is None:
            before = self._before(kind, after)
            least = min(before)
            found = self._back[kind, after] = (least, tuple(x - least if x < NEVER // 2 else NEVER for x in before))
        return found

    def _taken(self, kind: str, after: tuple, state: int) -> list[tuple[int, str, int]]:
        """Cost to the end, letter and next state of every edit that uses up the row."""
        out = [(DELETE + after[state], "D", state)]
        if kind != "d":
            more = TRUNCATED * kind.isupper()
            kept = _KEPT.get((kind.lower(), state))
            if kept is not None:
                out.append((more + after[kept], "K", kept))
            out.append((REROLE + more + after[_GIVEN[state]], "R", _GIVEN[state]))
        return out

    def _before(self, kind: str, after: tuple) -> tuple:
        least = [min(self._taken(kind, after, s))[0] for s in range(4)]
        for s in (USER, ASSISTANT, USER, START, SYSTEM):
            least[s] = min(least[s], INSERT + least[_GIVEN[s]])
        return tuple(least)

    def walk(self, kind: str, after: tuple, state: int) -> tuple[str, int]:
        """The ASCII-least tight letters up to the one that uses up the row, and the state after it."""
        found = self._walk.get((kind, after, state))
        if found is None:
            costs, letters, at = self._before(kind, after), "", state
            while True:
                tight = [(letter, to) for cost, letter, to in self._taken(kind, after, at) if cost == costs[at]]
                if INSERT + costs[_GIVEN[at]] == costs[at]:
                    tight.append(("I", _GIVEN[at]))
                letter, at = min(tight)
                letters += letter
                if letter != "I":
                    break
            found = self._walk[kind, after, state] = (letters, at)
        return found

    def vector(self, kinds: str, after: tuple) -> tuple[int, tuple]:
        """Least cost before a run, and the costs less it, from those after it (whose least entry is 0)."""
        total = 0
        for kind in reversed(kinds):
            more, after = self.back(kind, after)
            total += more
        return total, after

    def edits(self, kinds: str, state: int, after: tuple) -> tuple[str, int, int]:
        """Letters of a run from a state, the state after it, and what the run's edits cost."""
        width = max(1, math.isqrt(len(kinds)))
        cuts = list(range(0, len(kinds), width))
        held, costs = {}, after
        for cut in reversed(cuts):  # costs after each block are kept, those inside forgotten
            held[cut] = costs
            _, costs = self.vector(kinds[cut : cut + width], costs)
        out, spent = [], 0
        for cut in cuts:
            block, inside = kinds[cut : cut + width], [held.pop(cut)]
            for kind in reversed(block[1:]):
                inside.append(self.back(kind, inside[-1])[1])
            for kind in block:
                letters, state = self.walk(kind, inside.pop(), state)
                spent += sum({"I": INSERT, "D": DELETE, "R": REROLE}.get(x, 0) for x in letters) + TRUNCATED * (kind.isupper() and letters[-1] != "D")
                out.append(letters)
        return "".join(out), state, spent

    def matrix(self, kinds: str) -> list[int]:
        """Costs from each state before a run to each state after it, row by row."""
        columns = []
        for s in range(4):
            total, costs = self.vector(kinds, tuple(0 if t == s else NEVER for t in range(4)))
            columns.append([min(total + c, NEVER) for c in costs])
        return [columns[t][s] for s in range(4) for t in range(4)]


_RUN = "run bigint, conv_id {id}, turn bigint, role string, digest binary, edge boolean, kinds string, audit string, cost bigint, matrix array<bigint>, n array<bigint>, ends array<string>"


def _runs(table: pa.Table, firsts: pa.Table) -> pa.Table:
    """One row for each run of a conversation in a block; runs that touch no edge are whole and are walked at once.

    ``kinds`` has one letter a row: its initial (x if it is none of s, u, a), in upper case if truncated; d if it must go. ``n`` counts blank,
    duplicate, truncated and illegal rows, distinct turns and the least and greatest of them.
    """
    program = Program()
    table = table.take(pa.array(np.argsort(table["at"].to_numpy(), kind="stable")))
    at, ids = table["at"].to_numpy(), table["conv_id"]
    again = ~np.isin(at, firsts["at"].to_numpy())
    blank, cut = table["blank"].to_numpy(zero_copy_only=False), table["cut"].to_numpy(zero_copy_only=False)
    initials, turns, names = table["initial"].to_pylist(), table["turn"].to_pylist(), ids.to_pylist()
    known = [i if i in ("s", "u", "a") else "x" for i in initials]
    kinds = "".join("d" if b or a else k.upper() if c else k for k, a, b, c in zip(known, again.tolist(), blank.tolist(), cut.tolist(), strict=True))
    starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])] if names else []
    out = []
    for s, e in zip(starts, [*starts[1:], len(names)], strict=True):
        edge, mine, ini = s == 0 or e == len(names), kinds[s:e], initials[s:e]
        audit, cost, matrix = None, None, None
        if edge:
            matrix = program.matrix(mine)
        else:
            audit, _, cost = program.edits(mine, START, FINAL)
        seen = {t for t in turns[s:e] if t is not None}
        first = int((again[s:e] & ~blank[s:e]).sum())
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))
        n = [int(blank[s:e].sum()), first, sum(k.isupper() for k in mine), illegal, len(seen), min(seen, default=None), max(seen, default=None)]
        out.append((int(at[s]), edge, mine if edge else None, audit, cost, matrix, n, [ini[0], ini[-1]]))
    run, edge, mine, audit, cost, matrix, n, ends = zip(*out, strict=True) if out else [()] * 8
    heads = table.select(["conv_id", "turn", "role", "digest"]).take(pa.array(starts, pa.int64()))
    longs = pa.list_(pa.int64())
    arrays = [pa.array(run, pa.int64()), *heads.columns, pa.array(edge, pa.bool_()), pa.array(mine, pa.string()), pa.array(audit, pa.string()), pa.array(cost, pa.int64()), pa.array(matrix, longs), pa.array(n, longs), pa.array(ends, pa.list_(pa.string()))]
    return pa.Table.from_arrays(arrays, names=[x.split()[0] for x in _RUN.split(", ")])


def _costs_after(table: pa.Table) -> pa.Table:
    """Costs after each edge run of a conversation, by its matrices from the last run to the first."""
    table = table.sort_by([("run", "descending")])
    after, out = FINAL, []
    for m in table["matrix"].to_pylist():
        out.append(list(after))
        before = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
        after = tuple(b - min(before) for b in before)
    return pa.table({"run": table["run"], "after": pa.array(out, pa.list_(pa.int64()))})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, next state and cost of a run from each of the four states."""
    program = Program()
    for batch in batches:
        found = [[program.edits(kinds, s, tuple(after)) for s in range(4)] for kinds, after in zip(batch.column("kinds").to_pylist(), batch.column("after").to_pylist(), strict=True)]
        audits, states, costs = ([[x[k] for x in four] for four in found] for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column("run"), batch.column("conv_id"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64())), pa.array(costs, pa.list_(pa.int64()))],
            ["run", "conv_id", "audits", "states", "costs"],
        )


def _states_before(table: pa.Table) -> pa.Table:
    """The state in which each edge run of a conversation begins."""
    table = table.sort_by("run")
    state, out = START, []
    for states in table["states"].to_pylist():
        out.append(state)
        state = states[state]
    return pa.table({"run": table["run"], "state": pa.array(out, pa.int32())})


def _described(rows: DataFrame) -> DataFrame:
    """Rows with the digest by which equal turns are ordered."""
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _walked_runs(rows: DataFrame) -> DataFrame:
    """All runs with the letters of their edits."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    ship(spark)
    trimmed = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    slim = rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    slim = cut_lineage(slim.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.monotonically_increasing_id()))
    size = max(LEAST_BLOCK, 1 << (max(1, slim.count()).bit_length() // 2))
    block = F.floor(F.col("at") / size).alias("block")
    firsts = slim.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", block)
    runs = slim.select("*", block).groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_runs, _RUN.format(id=kind))
    runs = cut_lineage(runs)
    edges = runs.where("edge")
    after = edges.select("run", "conv_id", "matrix").groupBy("conv_id").applyInArrow(_costs_after, "run bigint, after array<bigint>")
    walked = edges.select("run", "conv_id", "kinds").join(after, "run").mapInArrow(_walked, f"run bigint, conv_id {kind}, audits array<string>, states array<bigint>, costs array<bigint>")
    walked = cut_lineage(walked)
    state = walked.select("run", "conv_id", "states").groupBy("conv_id").applyInArrow(_states_before, "run bigint, state int")
    chosen = walked.join(state, "run").select("run", F.get("audits", "state").alias("_audit"), F.get("costs", "state").alias("_cost"))
    done = edges.join(chosen, "run").withColumns({"audit": F.col("_audit"), "cost": F.col("_cost")}).select(runs.columns)
    return runs.where("not edge").unionAll(done).select("run", *ORDER, "audit", "cost", "n", "ends")


class _Conversation:
    """What the stream holds of the conversation at hand."""

    def __init__(self, name: object) -> None:
        self.name, self.letters, self.audit, self.state = name, iter(()), [], START
        self.pending: list[str] = []
        self.counts, self.cost, self.turns, self.greatest, self.least, self.last = [0] * 4, 0, 0, None, None, None

    def run(self, audit: str, cost: int, n: list, ends: list[str]) -> None:
        self.audit.append(audit)
        self.pending.append(audit)
        self.counts = [a + b for a, b in zip(self.counts, n[:4], strict=True)]
        self.cost += cost
        if self.last is not None and self.last + ends[0] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.last = ends[1]
        if n[5] is not None:
            self.turns += n[4] - (self.greatest == n[5])
            self.least, self.greatest = n[5] if self.least is None else self.least, n[6]

    def edit(self) -> str:
        """The next letter."""
        while True:
            letter = next(self.letters, None)
            if letter is not None:
                return letter
            self.letters = iter(self.pending.pop(0))

    def given(self) -> str:
        self.state = _GIVEN[self.state]
        return _ROLE[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what the next row becomes, with insertions before it."""
        while (letter := self.edit()) == "I":
            yield letter, self.given(), ""
        if letter == "R":
            yield letter, self.given(), text
        elif letter == "K":
            self.state = _KEPT[role[:1], self.state]
            yield letter, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while FINAL[self.state]:
            self.audit.append("I")
            self.cost += INSERT
            yield "I", self.given(), ""


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator[tuple[str, str, str]]]]:
    """Every conversation with the repaired turns of one row, or of its end (then ``None`` follows)."""
    held: _Conversation | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "what", "role", "text", "audit", "cost", "n", "ends")]
        for name, what, role, text, audit, cost, n, ends in zip(*columns, strict=True):
            if held is None or name != held.name:
                if held is not None:
                    yield held, held.end()
                    yield held, None
                held = _Conversation(name)
            if what == 0:
                held.run(audit, cost, n, ends)
            elif what == 1:
                yield held, held.row(role, text)
    if held is not None:
        yield held, held.end()
        yield held, None


#: Conversations in one batch of summaries, and repaired turns in one batch.
_OUT = 2000


def _summaries(kind: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, begun = [], hashlib.sha256(), False
        for held, turns in _conversations(batches):
            if turns is not None:
                for _, role, text in turns:
                    digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
                continue
            gaps = 0 if held.least is None else held.greatest - held.least + 1 - held.turns
            out.append((held.name, gaps, *held.counts, held.cost, "".join(held.audit), digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
            if len(out) == _OUT:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)
        give_back()

    return summed


def _repaired(kind: pa.DataType):
    names, kinds = ["conv_id", "place", "edit", "role", "text"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for held, turns in _conversations(batches):
            for edit, role, text in turns or ():
                out.append((held.name, place, edit, role, text))
                place += 1
            place = 0 if turns is None else place
            if len(out) >= _OUT:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    return listed


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _stream(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Letters of all runs and texts, sorted so that a conversation's letters come before the rows that use them up."""
    rows = _described(rows)
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("run", "bigint"), ("audit", "string"), ("cost", "bigint"), ("n", "array<bigint>"), ("ends", "array<string>"), ("text", "string"))}
    columns = ["what", *ORDER, "run", "audit", "cost", "n", "ends", "text"]

    def part(df: DataFrame, what: int) -> DataFrame:
        return df.withColumns({c: v for c, v in none.items() if c not in df.columns} | {"what": F.lit(what)}).select(columns)

    parts = part(_walked_runs(rows), 0).unionAll(part(rows, 1))
    if ids is not None:
        parts = parts.unionAll(part(ids.select(F.col("conv_id").cast(rows.schema["conv_id"].dataType).alias("conv_id")).distinct(), -1))
    return parts.repartition("conv_id").sortWithinPartitions(*ORDER, "what", "run")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``rows(conv_id, turn, role, text)``, and for each of ``ids(conv_id)`` without rows: its
    ``gaps`` in turn numbers, counts of ``blank``, ``duplicate``, ``truncated`` and ``illegal`` rows, the least ``cost``, the ``audit`` of edits
    and the SHA-256 of the repaired turns."""
    id_type = rows.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _stream(rows, ids).mapInArrow(_summaries(to_arrow_type(id_type)), schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of every turn after the repair."""
    id_type = rows.schema["conv_id"].dataType
    return _stream(rows, None).mapInArrow(_repaired(to_arrow_type(id_type)), f"conv_id {id_type.simpleString()}, place bigint, edit string, role string, text string")
