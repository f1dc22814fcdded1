"""Splitting oversized texts at natural boundaries by lexical cohesion.

Sliding word blocks on both sides of every sentence end give a similarity curve; its valleys mark changes of topic. Each
piece ends at the deepest valley of its size window (of equally deep ones at a paragraph end, else the later one), where
there is none at a word end, and only in an unbroken stretch within a word. The next piece starts ``overlap`` code points
before it.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.sentences import sentence_ends
from verseloom.runtime import map_batches

#: Fixed characters: a stretch without any of these is unbroken.
BREAKS = " \t\n\r\u00a0\u3000.!?。！？।؟"
_BREAK = re.compile(f"[{BREAKS}]")
_SPACES = re.compile(r"\s*")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)")
_TOKENS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}\p{M}]+")
_JOINED = regex.compile(r"[\p{M}\u200d]")
#: Words in each of the two blocks that are compared at a boundary.
BLOCK_WORDS = 40
#: Most limits in a table of limits; it is a setting, collected to the driver.
MOST_LIMITS = 1000


def cohesion_depths(text: str, boundaries: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """For each boundary, how deep a valley of block similarity it is: the rise to the nearest peak on either side.

    The two blocks are the ``block`` words before and after a boundary; their similarity is the cosine of word counts,
    found as the numbers of pairs of equal words across the blocks and within each."""
    known: dict[str, int] = {}
    ends, ids = [], []
    for m in _TOKENS.finditer(text):
        ends.append(m.end())
        ids.append(known.setdefault(m.group().lower(), len(known)))
    at = np.searchsorted(np.array(ends, np.int64), np.array(boundaries, np.int64), side="right")
    padded = np.concatenate([np.full(block, -1, np.int32), np.array(ids, np.int32), np.full(block, -2, np.int32)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, block)
    sims: list[float] = []
    equal = lambda x, y: (x[:, :, None] == y[:, None, :]).sum((1, 2))
    for k in range(0, len(at), 1000):
        left, right = blocks[at[k : k + 1000]], blocks[at[k : k + 1000] + block]
        dot, l2, r2 = equal(left, right), equal(left, left) - (left < 0).sum(1) ** 2, equal(right, right) - (right < 0).sum(1) ** 2
        sims += np.where((l2 > 0) & (r2 > 0), dot / np.sqrt(np.maximum(l2 * r2, 1)), 0.0).tolist()
    n = len(sims)
    rise = [0.0] * n
    for order in (range(n), range(n - 1, -1, -1)):
        peak, last = 0.0, None
        for i in order:
            # the nearest peak on this side: climb while the curve doesn't fall
            peak = sims[i] if last is None or sims[i] > last else max(peak, sims[i]) if sims[i] == last else peak
            rise[i] += max(0.0, peak - sims[i])
            last = sims[i]
    return rise


class _Plan:
    """Boundaries and valley depths of one text, found once for all limits."""

    def __init__(self, text: str):
        self.text = text
        ends = sentence_ends(text)
        self.at = [_SPACES.match(text, e).end() for e in ends]  # a piece keeps the white space after its last sentence
        self.kind = ["paragraph" if _PARAGRAPH.search(text, e, p) else "sentence" for e, p in zip(ends, self.at)]
        self.depth = cohesion_depths(text, self.at)
        self.held = (0, 0)  # the last stretch that was looked up

    def _deepest(self, low: int, high: int) -> tuple[int, str] | None:
        i, j = bisect.bisect_left(self.at, low), bisect.bisect_right(self.at, high)
        best = max(range(i, j), key=lambda k: (self.depth[k], self.kind[k] == "paragraph", self.at[k]), default=None)
        return None if best is None else (self.at[best], self.kind[best])

    def pieces(self, most: int, overlap: int) -> list[tuple[int, int, str]]:
        """Start, end and kind of cut."""
        text, out, start = self.text, [], 0
        while len(text) - start > most:
            high, least = start + most, start + overlap + 1
            cut = self._deepest(max(least, start + most // 2), high) or self._deepest(least, high)
            if cut is None:
                for p in range(high, least - 1, -1):
                    if text[p - 1] in BREAKS and (p == len(text) or text[p] not in BREAKS):
                        cut = (p, "word")
                        break
                else:
                    p = high
                    while p > least and p > high - 8 and _JOINED.match(text[p]):
                        p -= 1  # a mark stays with its letter
                    cut = (p, "hard")
            out.append((start, *cut))
            start = cut[0] - overlap
        out.append((start, len(text), "end"))
        return out

    def broken(self, cut: int) -> int:
        """Length of the unbroken stretch that a cut falls in; 0 if it is at a break or at the end."""
        if not self.held[0] < cut < self.held[1]:
            self.held = self._stretch(cut)
        return self.held[1] - self.held[0]

    def _stretch(self, cut: int) -> tuple[int, int]:
        """The unbroken stretch around a cut; an empty one if there is a break on either side."""
        text = self.text
        if cut == len(text) or text[cut - 1] in BREAKS or text[cut] in BREAKS:
            return cut, cut
        first, after = cut, _BREAK.search(text, cut)
        while first and text[first - 1] not in BREAKS:
            first -= 1
        return first, after.start() if after else len(text)


def split_oversized(df: DataFrame, id_col: str, text_col: str, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every text that is longer than a limit: for each row and ``limit_id`` the ``piece_no`` from 0,
    ``n_pieces``, ``start_char`` and ``end_char`` (code points; a piece has ``max_chars`` at most and starts exactly
    ``overlap_chars`` before the end of the one before), ``cut`` (what its end is: paragraph, sentence, word, hard or
    end), ``broken`` (the length of the unbroken stretch that its end is cut into, 0 if it is at a break) and, if
    ``with_text``, ``piece``.

    Texts within a limit, null and empty texts give no rows for it. Rows with equal ids are split each on its own; a null
    id stays null; other columns are ignored. A limit with a null in it or ``overlap_chars`` of ``max_chars`` or more is
    an error. Row-wise: no shuffle.
    """
    rows = limits.select("limit_id", "max_chars", "overlap_chars").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    for r in rows:
        if None in r or not 0 <= r.overlap_chars < r.max_chars:
            raise ValueError(f"not a usable limit: {r}")
    todo = sorted({(r.limit_id, r.max_chars, r.overlap_chars) for r in rows})
    kind = df.schema[id_col].dataType.simpleString()
    columns = ["id", "limit_id", "piece_no", "n_pieces", "start_char", "end_char", "cut", "broken"] + ["piece"] * with_text

    def run(ids: pa.Array, texts: pa.Array):
        out: dict[str, list] = {c: [] for c in columns}
        for i, text in zip(ids.to_pylist(), texts.to_pylist()):
            over = [x for x in todo if len(text) > x[1]]
            if not over:
                continue
            plan = _Plan(text)
            for limit, most, overlap in over:
                made = plan.pieces(most, overlap)
                for n, (a, b, cut) in enumerate(made):
                    for c, v in zip(columns, (i, limit, n, len(made), a, b, cut, plan.broken(b), text[a:b] if with_text else None)):
                        out[c].append(v)
        yield out

    least = min((m for _, m, _ in todo), default=0)
    long = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).where(F.char_length("__text") > least if todo else F.lit(False))
    schema = f"id {kind}, limit_id bigint, piece_no int, n_pieces int, start_char bigint, end_char bigint, cut string, broken bigint" + (", piece string" if with_text else "")
    return map_batches(long, run, schema).withColumnRenamed("id", id_col)


def oversize_report(pieces: DataFrame, id_col: str, limits: DataFrame) -> DataFrame:
    """From the pieces of :func:`split_oversized`: one row for each text, limit and ``kind`` — ``over`` (it had to be
    split) and ``unbroken`` (a piece's end had to be cut into a stretch longer than the limit; as no piece can hold such a
    stretch whole, each of them shows in a cut)."""
    known = limits.select("limit_id", "max_chars").distinct()
    if known.limit(MOST_LIMITS + 1).count() > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    per = pieces.groupBy(F.col(f"`{id_col}`"), "limit_id").agg(F.max("n_pieces").alias("n_pieces"), F.max("broken").alias("broken"))
    kinds = F.array(F.when(F.col("n_pieces") > 1, "over"), F.when(F.col("broken") > F.col("max_chars"), "unbroken"))
    return per.join(F.broadcast(known), "limit_id").select(F.col(f"`{id_col}`"), "limit_id", F.explode(F.array_compact(kinds)).alias("kind"))
