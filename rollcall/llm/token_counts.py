"""Edit-aware token counts.

A document keeps a tree over its pre-tokens: leaves hold the pre-tokens of a
stretch of text, every inner node the sums of characters and tokens below it.
An edit (replace the characters from ``start`` to ``end`` by ``text``) looks up
the leaf of its start by the character sums, splits again only from the last
pre-token that the edit cannot have changed up to the first old boundary that
comes back behind the edit, and updates the sums above the leaves it touched.

A match of the pattern looks at most one character past its end (a white-space
run gives its last character back to a following word), so a pre-token that
ends two or more characters before the edit stays as it is; behind the edit a
match depends only on the text from its start on, so everything after the
first common boundary stays too.

Defined cases: a null text counts as empty (0 tokens); an edit that reaches
past the text ends with it; edits with null or negative places, or with
``start`` past the text or over ``end``, are refused with ValueError in the
tree and skipped by ``recount``; edits apply in the order of their number,
each to the text the one before left; equal rows are counted each for itself.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.bpe import encoder
from rollcall.llm.common import map_text

LEAF = 64           # pre-tokens per leaf before it is split
KEPT_COUNTS = 1 << 18
_COUNTS: dict = {}


def counter(rank_file: str, pattern: str):
    """Function from a pre-token to its number of tokens; remembers a bounded number of them per Python worker."""
    enc = encoder(rank_file, pattern)
    known = _COUNTS.setdefault((rank_file, pattern), {})

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= KEPT_COUNTS:
                known.clear()
            n = known[piece] = len(enc.encode_ordinary(piece))
        return n

    return count


class Leaf:
    __slots__ = ("pieces", "chars", "tokens")

    def __init__(self, pieces: list[tuple[int, int]]):
        self.pieces = pieces                        # (characters, tokens) of each pre-token
        self.chars = sum(c for c, _ in pieces)
        self.tokens = sum(t for _, t in pieces)


class TokenTree:
    """A balanced tree of sums in arrays: level 0 are the leaves, each level above adds pairs."""

    def __init__(self, text: str, split, count):
        self.text, self.split, self.count = text, split, count
        self.encoded = 0
        pieces = self._encode(split.finditer(text))
        self.leaves = [Leaf(pieces[i:i + LEAF]) for i in range(0, len(pieces), LEAF)] or [Leaf([])]
        self._build()

    def _encode(self, matches) -> list[tuple[int, int]]:
        out = [(m.end() - m.start(), self.count(m[0])) for m in matches]
        self.encoded += len(out)
        return out

    def _build(self) -> None:
        self.levels = [[(x.chars, x.tokens) for x in self.leaves]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([self._pair(low, i) for i in range(0, len(low), 2)])

    @staticmethod
    def _pair(low: list, i: int) -> tuple[int, int]:
        if i + 1 < len(low):
            return low[i][0] + low[i + 1][0], low[i][1] + low[i + 1][1]
        return low[i]

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """Number and first character of the leaf that holds a place (the last leaf for the end)."""
        at, before = 0, 0
        for low in reversed(self.levels[:-1]):
            at *= 2
            if at + 1 < len(low) and place >= before + low[at][0]:
                before += low[at][0]
                at += 1
        return at, before

    def edit(self, start: int, end: int, new: str) -> None:
        if start is None or end is None or not 0 <= start <= len(self.text) or end < start:
            raise ValueError("an edit must lie in the text")
        end = min(end, len(self.text))
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        # the pre-token two characters before the edit is the first that the edit can reach
        reach = max(0, start - 2)
        first, at = self._leaf_at(reach)
        pieces, keep = self.leaves[first].pieces, 0
        while keep < len(pieces) and at + pieces[keep][0] <= reach:
            at += pieces[keep][0]
            keep += 1
        # new pre-tokens until one begins at an old boundary behind the edit
        old, rest, fresh = at, self._pieces_from(first, keep), []
        step = next(rest, None)
        for m in self.split.finditer(text, at):
            place = m.start() - shift
            while step is not None and old < place:
                old += step[2]
                step = next(rest, None)
            if place >= end and old == place and step is not None:
                break
            fresh.append((m.end() - m.start(), self.count(m[0])))
        else:
            step = None
        self.encoded += len(fresh)
        stop = len(self.leaves) if step is None else step[0] + 1
        tail = [] if step is None else self.leaves[step[0]].pieces[step[1]:]
        joined = pieces[:keep] + fresh + tail
        made = [Leaf(joined[i:i + LEAF]) for i in range(0, len(joined), LEAF)]
        self.text = text
        same = len(made) == stop - first
        self.leaves[first:stop] = made
        if same:
            self._update(first, stop)
        else:
            self.leaves = self.leaves or [Leaf([])]
            self._build()

    def _pieces_from(self, leaf: int, piece: int):
        """(leaf, piece, characters) of the pre-tokens from a place on."""
        for i in range(leaf, len(self.leaves)):
            for k in range(piece if i == leaf else 0, len(self.leaves[i].pieces)):
                yield i, k, self.leaves[i].pieces[k][0]

    def _update(self, first: int, stop: int) -> None:
        for i in range(first, stop):
            self.levels[0][i] = (self.leaves[i].chars, self.leaves[i].tokens)
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            first, stop = first // 2, (stop - 1) // 2 + 1
            for i in range(first, stop):
                high[i] = self._pair(low, 2 * i)


EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("text", T.StringType())])


def recount(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``row`` (the input row) and ``n_before``, ``n_after`` (tokens), ``n_pieces`` (pre-tokens of the first text),
    ``n_encoded`` (pre-tokens that the edits made anew), ``n_skipped`` (refused edits) and ``edited`` (the last text).

    ``edits_col``: array of (start, end, text) in code points, in order; null is no edit.
    """
    fields = [T.StructField(n, T.LongType()) for n in ("n_before", "n_after", "n_pieces", "n_encoded", "n_skipped")]
    fields.append(T.StructField("edited", T.StringType()))

    def run(batches):
        split, count = regex.compile(pattern), counter(rank_file, pattern)
        for pairs in batches:
            out = [[] for _ in fields]
            for pair in pairs:
                tree = TokenTree(pair["text"] or "", split, count)
                before, pieces, skipped = tree.tokens, tree.encoded, 0
                for e in pair["edits"] or ():
                    try:
                        tree.edit(e["start"], e["end"], e["text"] or "")
                    except (ValueError, TypeError):
                        skipped += 1
                for column, v in zip(out, (before, tree.tokens, pieces, tree.encoded - pieces, skipped, tree.text),
                                     strict=True):
                    column.append(v)
            yield out

    paired = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.struct(F.col(text_col).alias("text"), F.col(edits_col).cast(T.ArrayType(EDIT)).alias("edits"))
                       .alias("pair"))
    return map_text(paired, "pair", fields, run, row="both").select(
        F.col("both.row").alias("row"), *[f.name for f in fields])
