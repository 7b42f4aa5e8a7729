"""Conversation structure: faults of each row, the cheapest repair, and the repaired text.

Every row of a conversation becomes one symbol: its role's initial with or
without a truncated end, or "must go" for blank and repeated rows.  Repair is a
shortest path over the states of the wanted shape ``(s?(ua)+)?``: start, behind
a system row, behind a user row, behind an assistant row.  A row is a min-plus
matrix over these states whose entries hold the cost and the edits' initials, and
a sequence of rows is the product of their matrices.

Grammar-compressed DP: the sequences that a task reads are compressed by
Re-Pair (the most frequent pair of neighbours becomes a rule until no pair
repeats); every rule has one matrix, computed once from its two sides, bottom-up,
and kept for all later conversations of the worker.  An entry's edits are a rope,
so a product joins two references.  Of equal costs the ASCII-least edits
win; two ropes of equal cost are never one the beginning of the other, since
the longer one would only add insertions, so the choice may be made within rules.

Partitioning: rows without their texts are ordered by conversation and turn
across all tasks, so a conversation with a third of all rows is spread over
many of them; each task gives one matrix per stretch of a conversation, and
stretches are multiplied in order.  First occurrences of (role, text) are found
by an aggregate that combines before its shuffle and a join on whole row keys.
Only the last step follows a conversation alone, because one hash runs
through its whole text: it streams stretches and texts in order and holds
one row at a time besides the edits, which the result holds anyway.

Defined cases: a null role or text is one space, a null conversation is one of its
own, null turns come first.  Rows of one turn come by role, then by the
SHA-256 of the text; repeated rows are one row with copies.  A conversation
whose rows are all dropped keeps its row with zeros.  An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import get_ready

STATES = 4                      # start, behind system, behind user, behind assistant
GONE = "x"                      # symbol of rows that must go
BATCH_ROWS = 50_000             # symbols that are compressed together
KEPT_RULES = 100_000
_STEP = {"u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),), "s": ((0, 1),)}
LETTERS = {"keep": "K", "rerole": "R", "delete": "D", "insert": "I"}


# ---------------------------------------------------------------- ropes: a string, or (length, left, right)

FLAT = 128


def join(x, y):
    """Both in order; short ropes become strings."""
    if x == "":
        return y
    if y == "":
        return x
    n = length(x) + length(y)
    return text_of(x) + text_of(y) if n <= FLAT else (n, x, y)


def length(x) -> int:
    return len(x) if isinstance(x, str) else x[0]


def leaves(x) -> Iterator[str]:
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += (x[2], x[1])


def text_of(x) -> str:
    return x if isinstance(x, str) else "".join(leaves(x))


def less(x, y) -> bool:
    """Whether x comes before y; equal subropes at equal places are skipped by reference."""
    left, right = [x], [y]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b:
            continue
        if isinstance(a, str) and isinstance(b, str):
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a < b
            if len(a) > n:
                left.append(a[n:])
            if len(b) > n:
                right.append(b[n:])
        elif isinstance(b, str) or not isinstance(a, str) and a[0] >= b[0]:
            left += (a[2], a[1])
            right.append(b)
        else:
            left.append(a)
            right += (b[2], b[1])
    return not left and bool(right)


# ---------------------------------------------------------------- min-plus matrices over (cost, rope); None: no way

def better(x, y):
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if less(y[1], x[1]) else x


def product(m, n):
    out = []
    for row in m:
        new = [None] * STATES
        for mid, x in enumerate(row):
            if x is not None:
                for to, y in enumerate(n[mid]):
                    if y is not None and (new[to] is None or x[0] + y[0] <= new[to][0]):
                        new[to] = better(new[to], (x[0] + y[0], join(x[1], y[1])))
        out.append(tuple(new))
    return tuple(out)


def _matrix(entries) -> tuple:
    m = [[None] * STATES for _ in range(STATES)]
    for at, to, cost, letters in entries:
        m[at][to] = better(m[at][to], (cost, letters))
    return tuple(map(tuple, m))


ONE = _matrix([(q, q, 0, "") for q in range(STATES)])
_INSERT = _matrix([(q, r, 2, LETTERS["insert"]) for role in "ua" for q, r in _STEP[role]])
# Rows may be inserted anywhere; as many as there are states reach all that insertions reach cheapest.
INSERTS = ONE
for _ in range(STATES):
    INSERTS = tuple(tuple(better(a, b) for a, b in zip(x, y, strict=True))
                    for x, y in zip(ONE, product(INSERTS, _INSERT), strict=True))


def row_matrix(symbol: str) -> tuple:
    """One row and what may be inserted behind it."""
    if symbol == GONE:
        return product(_matrix([(q, q, 3, LETTERS["delete"]) for q in range(STATES)]), INSERTS)
    more = int(symbol.isupper())            # truncated
    ways = [(q, q, 3, LETTERS["delete"]) for q in range(STATES)]
    ways += [(q, r, 2 + more, LETTERS["rerole"]) for role in "ua" for q, r in _STEP[role]]
    ways += [(q, r, more, LETTERS["keep"]) for q, r in _STEP.get(symbol.lower(), ())]
    return product(_matrix(ways), INSERTS)


def symbol_of(initial: str, gone: bool, truncated: bool) -> str:
    if gone:
        return GONE
    symbol = initial if initial in _STEP else "o"
    return symbol.upper() if truncated else symbol


class Grammar:
    """Rules with their matrices; symbols are letters or pairs of numbers of symbols."""

    def __init__(self):
        self.number: dict = {}
        self.matrices: list[tuple] = []

    def of(self, key) -> int:
        """The number of a letter or of a pair of numbers; its matrix is computed when first seen."""
        k = self.number.get(key)
        if k is None:
            k = self.number[key] = len(self.matrices)
            self.matrices.append(row_matrix(key) if isinstance(key, str) else
                                 product(self.matrices[key[0]], self.matrices[key[1]]))
        return k

    def repair(self, sequences: list[str]) -> list[list[int]]:
        """Re-Pair over all sequences together: the most frequent pair becomes a rule until none repeats."""
        if len(self.matrices) > KEPT_RULES:
            self.__init__()
        signs: list[int] = []
        starts = []
        for s in sequences:
            starts.append(len(signs))
            signs += [self.of(c) for c in s]
            signs.append(-1)                # no pair spans two sequences
        n = len(signs)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in range(n - 1):
            if signs[i] >= 0 and signs[i + 1] >= 0:
                where[signs[i], signs[i + 1]].add(i)
        heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
        heapq.heapify(heap)
        while heap:
            found, pair = heapq.heappop(heap)
            at = where.get(pair, ())
            if len(at) < 2 or len(at) != -found:
                if len(at) > 1:
                    heapq.heappush(heap, (-len(at), pair))
                continue
            rule, changed = self.of(pair), set()
            for i in sorted(at):
                if i not in at:             # overlapped the one before, as in x x x
                    continue
                j = after[i]
                if signs[i] != pair[0] or j >= n or signs[j] != pair[1]:
                    continue
                left, right = before[i], after[j]
                if left >= 0 and signs[left] >= 0:
                    where[signs[left], signs[i]].discard(left)
                    where[signs[left], rule].add(left)
                    changed.add((signs[left], rule))
                if right < n and signs[right] >= 0:
                    where[signs[j], signs[right]].discard(j)
                    where[rule, signs[right]].add(i)
                    changed.add((rule, signs[right]))
                signs[i], signs[j] = rule, -2
                after[i] = right
                if right < n:
                    before[right] = i
            where.pop(pair, None)
            for p in changed:
                if len(where[p]) > 1:
                    heapq.heappush(heap, (-len(where[p]), p))
        out = []
        for k, start in enumerate(starts):
            i, row = start, []
            while signs[i] != -1:
                row.append(signs[i])
                i = after[i]
            out.append(row)
        return out

    def matrix_of(self, sequences: list[str]) -> dict[str, tuple]:
        """The matrix of each distinct sequence."""
        distinct = list(dict.fromkeys(sequences))
        out = {}
        for s, row in zip(distinct, self.repair(distinct), strict=True):
            m = ONE
            for k in row:
                m = self.matrices[k] if m is ONE else product(m, self.matrices[k])
            out[s] = m
        return out


# ---------------------------------------------------------------- Spark

def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage with ``times`` they occur (0, 1 or 2); nulls of role and text are one space."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("k"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("times"))


_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: how often they occur, whether they are blank, truncated, and the first of their kind."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    light = rows.filter("times > 0").select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (F.length(bare) == 0).alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "times")
    keys = ["conv_id", "turn", "role", "digest"]
    light = light.groupBy(*keys).agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    firsts = light.groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("turn")).select(
        "conv_id", "role", "digest", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), F.lit(True).alias("is_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return light.alias("l").join(firsts.alias("f"), same, "left").select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "times", "blank", "truncated", F.coalesce("is_first", F.lit(False)).alias("is_first"))


_PARTS = ("conv_id bigint, turn bigint, role string, digest string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "n_turns bigint, min_turn bigint, max_turn bigint, last_turn bigint, first_initial string, last_initial string, "
          "costs array<bigint>, audits array<string>")
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}


def stretches(marked: DataFrame) -> DataFrame:
    """For each stretch of a conversation that lies together in a task: its counts, ends and matrix."""
    ordered = marked.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    names = [f.strip().split(" ")[0] for f in _PARTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.string(),
             pa.list_(pa.int64()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        open_part: dict | None = None
        waiting: list[dict] = []
        symbols = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """All waiting stretches; the last may go on and keeps its matrix so far."""
            nonlocal symbols
            matrices = grammar.matrix_of(["".join(p["symbols"]) for p in waiting])
            for p in waiting:
                m = matrices["".join(p["symbols"])]
                p["matrix"] = m if p["matrix"] is None else product(p["matrix"], m)
                p["symbols"] = []
            closed = [p for p in waiting if p is not open_part]
            waiting[:] = [p for p in waiting if p is open_part]
            symbols = 0
            if closed:
                cells = [[x for row in p["matrix"] for x in row] for p in closed]
                columns = [[p[n] for p in closed] for n in names[:-2]]
                columns += [[[x and x[0] for x in c] for c in cells], [[x and text_of(x[1]) for x in c] for c in cells]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for conv, turn, role, digest, times, blank, truncated, first in zip(
                    *(batch.column(batch.schema.get_field_index(c)).to_pylist()
                      for c in ("conv_id", "turn", "role", "digest", "times", "blank", "truncated", "is_first")), strict=True):
                initial, p = role[:1], open_part
                if p is None or p["conv_id"] != conv:
                    p = open_part = {"conv_id": conv, "turn": turn, "role": role, "digest": digest, **dict.fromkeys(_COUNTS, 0), "n_turns": 0,
                                     "min_turn": None, "max_turn": None, "first_initial": initial, "last_initial": None, "last_turn": None,
                                     "matrix": None, "symbols": []}
                    waiting.append(p)
                if turn is not None and turn != p["last_turn"]:
                    p["n_turns"] += 1
                    p["min_turn"] = turn if p["min_turn"] is None else p["min_turn"]
                    p["max_turn"] = turn
                p["last_turn"] = turn
                if p["last_initial"] is not None:
                    p["illegal"] += p["last_initial"] + initial not in LEGAL
                p["illegal"] += times - 1           # a role never follows itself
                p["last_initial"] = initial
                if blank:
                    p["blank"] += times
                else:
                    p["duplicate"] += times - first
                    p["truncated"] += first and truncated
                gone = times if blank else times - first
                p["symbols"].append(("" if blank or not first else symbol_of(initial, False, truncated)) + GONE * gone)
                symbols += times
                if symbols >= BATCH_ROWS:
                    yield from flush()
        open_part = None
        if waiting:
            yield from flush()

    return ordered.mapInArrow(run, _PARTS)


_RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost and initials of the cheapest edits, hash of the repaired text."""
    get_ready(conversations.sparkSession)
    rows = damage(conversations)
    parts = stretches(_marked(rows))
    # every row, dropped ones too, so that each conversation has its row; blank texts are never in a result
    texts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "text", "times")
    both = parts.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.mapInArrow(_finish, _RESULT)


class _Conversation:
    """One conversation as its stretches and then its rows come by."""

    def __init__(self, conv_id):
        self.conv_id, self.vector, self.audit, self.at = conv_id, INSERTS[0], None, 0
        self.counts, self.n_turns, self.low, self.high, self.last = dict.fromkeys(_COUNTS, 0), 0, None, None, None
        self.hash, self.any, self.next_role = hashlib.sha256(), False, None
        self.cost = 0

    def stretch(self, r: dict) -> None:
        cells = [None if c is None else (c, t) for c, t in zip(r["costs"], r["audits"], strict=True)]
        matrix = [cells[q * STATES:(q + 1) * STATES] for q in range(STATES)]
        self.vector = product((self.vector,), matrix)[0]
        for c in _COUNTS:
            self.counts[c] += r[c]
        if self.last is not None:
            self.counts["illegal"] += self.last["last_initial"] + r["first_initial"] not in LEGAL
        self.n_turns += r["n_turns"]
        if r["min_turn"] is not None:
            if self.high is not None and self.high == r["min_turn"]:
                self.n_turns -= 1           # one turn in two stretches
            self.low = r["min_turn"] if self.low is None else self.low
            self.high = r["max_turn"]
        self.last = r

    def settle(self) -> None:
        """The cheapest way to an accepting state; edits before the first row are insertions."""
        if self.audit is None:
            end = better(self.vector[0], self.vector[3]) if self.last is not None else (0, "")
            self.cost, self.audit = end[0], text_of(end[1])

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == LETTERS["keep"]:
            self.emit(role, text)
        elif edit == LETTERS["rerole"]:
            self.emit(self.next_role or "user", text)

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == LETTERS["insert"]:
            self.at += 1
            self.emit(self.next_role or "user", "")

    def emit(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any, self.next_role = True, "assistant" if role[:1] == "u" else "user"

    def result(self) -> tuple:
        self.settle()
        self.inserts()
        gaps = self.high - self.low + 1 - self.n_turns if self.low is not None else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.hash.hexdigest())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.strip().split(" ")[0] for f in _RESULT.split(",")]
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    now: _Conversation | None = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(r["conv_id"])
            if r["kind"] == 0:
                now.stretch(r)
            else:
                now.settle()
                for _ in range(r["times"]):
                    now.row(r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.result(), types, strict=True)], names=names)
