"""Wu-Manber search against a plain scan."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import decontamination as d
from rollcall.llm.common import words_of

WORD = st.sampled_from([b"a", b"b", b"c", b"d"])


def plain(words, items, window):
    hit, found = set(), set()
    for n, item in items:
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == item[i:i + size]:
                    hit |= set(range(at, at + size))
                    found.add(n)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, max_size=40), st.lists(st.lists(WORD, max_size=9), max_size=5), st.integers(1, 5))
def test_search(words, items, window):
    numbered = list(enumerate(items))
    spans, found = d.Matcher(numbered, window).hits(words)
    covered = {p for a, b in d.merged(spans) for p in range(a, b)}
    assert (covered, found) == plain(words, numbered, window)


def test_words():
    assert words_of("Ünder THE  x-ray42 b\x7f\n`{}") == ["Ünder".encode(), b"the", b"x", "ray42 b".encode()]
    assert words_of(None) == words_of("") == words_of(" -- ") == []


def test_blocks_and_table_cases(spark):
    item = " ".join(f"w{i}" for i in range(500))
    bench = spark.createDataFrame(
        [(7, item), (7, item), (8, "short item Here"), (9, None), (10, " .. "), (None, "null id words"), (11, "one")],
        "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " + " ".join(f"W{i}," for i in range(100, 112)) + " y", "s"), (2, "a SHORT item: here b", "s"), (3, None, "s"),
         (4, "", "s"), (5, "null id words", "s"), (5, "null id words", "s"), (None, "short item here " * 20000, "s"),
         (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 no", "s"), (12, "only one here", "s")], "doc_id long, text string, spans string")
    results = []
    for size in (1 << 24, 900):             # one block, and many
        found = d.find(docs, bench, block_bytes=size)
        got = found.select("row.doc_id", "n_words", d.hit_words("spans").alias("hit"), "items", "row.spans").collect()
        results.append(sorted(map(str, got)))
        by = {r.doc_id: r for r in got}
        assert (by[1].n_words, by[1].hit, by[1]["items"]) == (14, 12, ["7"])
        assert (by[2].hit, by[2]["items"]) == (3, ["8"])
        assert by[3].n_words == by[4].n_words == by[6].hit == 0
        assert (by[5].hit, by[5]["items"]) == (3, [])        # an item without an id hits, but has no name to list
        assert by[None].hit == 60000 and by[12]["items"] == ["11"] and by[2][4] == "s"
    assert results[0] == results[1] and len(results[0]) == 9
    kept = d.clean_rows(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    assert d.find(docs, bench.limit(0)).filter("size(items) = 0").count() == 9
    assert d.find(docs.limit(0), bench).count() == 0


def test_items_without_an_id_hit_but_are_not_listed(spark):
    from rollcall.llm import decontamination as d
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, None), (3, "six seven eight nine ten eleven one")], "item_id long, text string")
    got = {r.row.doc_id: r for r in d.find(docs, bench).collect()}
    assert [tuple(s) for s in got[1].spans] == [(0, 11)] and got[1]["items"] == []
    assert [r.doc_id for r in d.clean_rows(docs, bench).collect()] == [2]
