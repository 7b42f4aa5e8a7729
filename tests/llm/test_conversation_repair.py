"""Conversation repair against a row-by-row dynamic programme over whole audits."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import conversation_repair as cr
from rollcall.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))


def cheapest(rows, kinds):
    """(cost, audit, repaired rows), all ways kept per state with their whole audits."""
    def keep(d, q, v):
        if q not in d or v[:2] < d[q][:2]:
            d[q] = v

    def insert(d):
        for _ in range(5):
            for q, (c, a, o) in list(d.items()):
                for name in ("user", "assistant"):
                    if (name[0], q) in STEP:
                        keep(d, STEP[name[0], q], (c + 2, a + "I", o + ((name, ""),)))
        return d

    best = insert({0: (0, "", ())})
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        for q, (c, a, o) in best.items():
            keep(new, q, (c + 3, a + "D", o))
            if kind in "bd" and kind:
                continue
            more = kind == "t"
            for name in ("user", "assistant"):
                if (name[0], q) in STEP:
                    keep(new, STEP[name[0], q], (c + 2 + more, a + "R", o + ((name, text),)))
            if (role[:1], q) in STEP:
                keep(new, STEP[role[:1], q], (c + more, a + "K", o + ((role, text),)))
        best = insert(new)
    return min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])


def kinds_of(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return kinds


def brute(table):
    by = {}
    for c, *r in table:
        by.setdefault(c, []).append(r)
    out = []
    for conv, rows in by.items():
        rows = damaged(conv, rows)
        kinds = kinds_of(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, repaired = cheapest(rows, kinds) if rows else (0, "", ())
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="suaoSUAOx", max_size=30), min_size=1, max_size=8))
def test_grammar_gives_the_cheapest_edits(sequences):
    matrices = cr.Grammar().matrix_of(sequences)
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for s in sequences:
        end = cr.product((cr.INSERTS[0],), matrices[s])[0]
        got = cr.better(end[0], end[3])
        rows = [(0, role[c.lower()], "") for c in s]
        kinds = ["b" if c == "x" else "t" if c.isupper() else "" for c in s]
        assert (got[0], cr.text_of(got[1])) == cheapest(rows, kinds)[:2]


def test_pairs_that_repeat_become_rules():
    grammar = cr.Grammar()
    rows = grammar.repair(["uauauaua" * 50, "xxxxxxxx", "sua"])
    letters = {k: key for key, k in grammar.number.items()}

    def spell(k):
        key = letters[k]
        return key if isinstance(key, str) else spell(key[0]) + spell(key[1])
    assert ["".join(map(spell, r)) for r in rows] == ["uauauaua" * 50, "xxxxxxxx", "sua"]
    assert sum(map(len, rows)) < 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="DIKR", max_size=400), st.text(alphabet="DIKR", max_size=400), st.integers(1, 9))
def test_ropes_compare_like_strings(x, y, step):
    def rope(s):
        out = ""
        for i in range(0, len(s), step):
            out = (len(s[:i + step]), out, s[i:i + step]) if out else s[:step]
        return out
    assert cr.less(rope(x), rope(y)) == (x < y) and cr.text_of(rope(x)) == x


def rows_of(seed, convs, turns):
    rng = random.Random(seed)
    return [(rng.choice([c, c, c, None]) if c == 0 else c, rng.choice([t, t, t, t - 1, None]),
             rng.choice(["user", "assistant", "system", "tool", None, "", "ünter"]),
             rng.choice(["a.", "b", "Why?", " \t", "", None, "no end ", "a.", "ok!\n"])) for c in range(convs) for t in range(turns)]


def check(spark, table):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA + ", audit string, kind int")
    got = sorted(map(tuple, cr.repair(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == brute(table)


def test_tables_against_brute_force(spark):
    check(spark, rows_of(1, 60, 7))
    check(spark, rows_of(2, 1, 400) + rows_of(3, 3, 40))        # one conversation with most rows, over many tasks


def test_copies_long_texts_and_dropped_rows(spark):
    check(spark, [(1, 1, "user", "same.")] * 30 + [(1, 1, "user", "other.")] * 2 + [(2, 5, "assistant", "x" * 200_000)])
    dropped = next((c, 0, "user", "a.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [dropped])
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_conversations(spark):
    got = sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()))
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == brute([tuple(r) for r in table])
