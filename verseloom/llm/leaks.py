"""Evaluation texts that leak into training text.

Every item is split into pieces, one more than the errors it may have, so that a document with that many errors or fewer
holds at least one piece exactly (pigeonhole). The pieces are runs of five consecutive words; the errors are the runs
that a document may lack. Documents are scanned once for exact piece hits; every document and item that meet are then
verified by the exact share of the item's runs; Myers' bit-parallel edit distance of the item, in words, to the best
passage of the document is reported. In :func:`find_passages` the pieces are disjoint, the errors are word edits, and
Myers' distance decides.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm._text import words
from verseloom.runtime import map_batches, materialize

#: Words in a run.
RUN = 5
#: Code points of items whose index is broadcast (some 100 MB in each Python worker at this bound). The pieces of more
#: items than that are joined with the runs of the documents by a shuffle.
PASS_CHARS = 2_000_000


def passage_distance(pattern: list, text: list) -> int:
    """Least edit distance of ``pattern`` to any passage of ``text``: Myers' bit-parallel column update, with one bit for
    each element of the pattern, in integers of any length."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full  # a passage may start anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


def needed_runs(n: int, share: float) -> int:
    """Least number of an item's ``n`` runs that is ``share`` of them."""
    return max(1, -int(-n * share // 1))


def run_keys(found: list[str], step: int = 1) -> np.ndarray:
    """Distinct 64-bit keys of the runs of five words that begin at every ``step``-th word."""
    if len(found) < RUN:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found))
    starts = np.arange(0, len(h) - RUN + 1, step)
    return np.unique(ItemIndex._hash([h[starts + k] for k in range(RUN)])).view(np.int64)


class ItemIndex:
    """Words, runs and pieces of a block of items, for one pass over the documents."""

    def __init__(self, items: list[tuple], share: float):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        runs: dict[tuple, int] = {}
        holders: list[int] = []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            own = list(dict.fromkeys(tuple(ids[k : k + RUN]) for k in range(len(ids) - RUN + 1)))
            if not own:
                continue
            numbers = [runs.setdefault(r, len(runs)) for r in own]
            holders += [0] * (len(runs) - len(holders))
            for n in numbers:
                holders[n] += 1
            self.items.append((key, ids, np.unique(numbers)))
        self.tuples = np.array(list(runs), np.int64).reshape(-1, RUN)
        self.hash = self._hash([self.tuples[:, k] for k in range(RUN)])
        self.order = np.argsort(self.hash, kind="stable")
        self.sorted = self.hash[self.order]
        self.need, self.piece_items = [], {}
        for at, (_, _, numbers) in enumerate(self.items):
            need = needed_runs(len(numbers), share)
            self.need.append(need)
            # budget + 1 pieces; those that few items share are hit least often by chance
            for n in sorted(numbers, key=lambda n: (holders[n], n))[: len(numbers) - need + 1]:
                self.piece_items.setdefault(int(n), []).append(at)
        self.is_piece = np.zeros(len(runs) + 1, bool)
        self.is_piece[list(self.piece_items)] = True

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def runs_of(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the distinct item runs that a sequence of word numbers (-1: in no item) holds."""
        if len(ids) < RUN or not len(self.tuples):
            return np.zeros(0, np.int64)
        known = np.convolve(ids >= 0, np.ones(RUN, np.int64), "valid") == RUN
        at = np.flatnonzero(known)
        if not len(at):
            return at
        columns = [ids[at + k] for k in range(RUN)]
        h = self._hash(columns)
        where = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        number = self.order[where]
        equal = (self.sorted[where] == h) & (self.tuples[number] == np.column_stack(columns)).all(axis=1)
        return np.unique(number[equal])

    def leaks(self, text: str | None) -> list[tuple]:
        """``(item, shared runs, runs, needed, words, distance)`` of every item of which the text holds a piece."""
        found = words(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in found), np.int64, len(found))
        held = self.runs_of(ids)
        pieces = held[self.is_piece[held]]
        if not len(pieces):
            return []
        out = []
        for at in sorted({i for n in pieces.tolist() for i in self.piece_items[n]}):
            key, own, numbers = self.items[at]
            shared = int(np.isin(numbers, held, assume_unique=True).sum())
            if shared >= self.need[at]:
                out.append((key, shared, len(numbers), len(own), passage_distance(own, ids.tolist())))
        return out


class PieceIndex(ItemIndex):
    """Items cut into disjoint pieces of five words, one more than the word edits that an item may have: a passage with
    that many edits or fewer holds at least one piece exactly, as one edit spoils one piece at most."""

    def __init__(self, items: list[tuple]):
        self.vocabulary, self.items, self.piece_items = {}, [], {}
        pieces: dict[tuple, int] = {}
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if len(ids) < RUN:
                continue
            for k in range(0, len(ids) - RUN + 1, RUN):
                self.piece_items.setdefault(pieces.setdefault(tuple(ids[k : k + RUN]), len(pieces)), set()).add(len(self.items))
            self.items.append((key, ids, len(ids) // RUN - 1))
        self.tuples = np.array(list(pieces), np.int64).reshape(-1, RUN)
        self.hash = self._hash([self.tuples[:, k] for k in range(RUN)])
        self.order = np.argsort(self.hash, kind="stable")
        self.sorted = self.hash[self.order]

    def leaks(self, text: str | None) -> list[tuple]:
        """``(item, words, budget, distance)`` of every item within its budget of a passage of the text."""
        found = words(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in found), np.int64, len(found))
        out, present, listed = [], None, None
        for at in sorted({i for n in self.runs_of(ids).tolist() for i in self.piece_items[n]}):
            key, own, budget = self.items[at]
            if listed is None:
                listed, present = ids.tolist(), np.zeros(len(self.vocabulary) + 1, bool)
                present[ids] = True  # words of no item fall on the last place
                present[-1] = False
            if np.count_nonzero(~present[own]) > budget:
                continue  # every word of the item that the text hasn't at all costs an edit
            distance = passage_distance(own, listed)
            if distance <= budget:
                out.append((key, len(own), budget, distance))
        return out


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, share: float = 0.5) -> DataFrame:
    """Documents that hold ``share`` of an item's distinct runs of five words, or more: document id, item id, ``shared``
    and ``runs``, ``item_words``, and ``distance``, the edit distance in words of the item to the document's best passage
    (0: it is there word for word).

    All documents are scanned whole, once. Up to ``PASS_CHARS`` of items are broadcast, so that nothing is shuffled; the
    pieces of more are joined with the documents' runs, and the pairs that meet are verified. Null and empty texts and
    items of fewer than five words leak nothing; repeated documents each have their rows; items with equal ids are joined
    in the result; other columns are ignored; empty tables give no rows.
    """
    return _scan(docs, id_col, text_col, items, item_id, item_text, lambda block: ItemIndex(block, share), lambda wanted: _rarest(wanted, share), ("shared", "runs", "item_words", "distance"))


def find_passages(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Documents with a passage that is an item but for a budget of word edits (a fifth of its words, rounded down, less
    one): document id, item id, ``item_words``, ``budget`` and ``distance``. An exact hit of a piece makes a candidate,
    Myers' distance decides. Inputs are treated as in :func:`find_leaks`."""
    return _scan(docs, id_col, text_col, items, item_id, item_text, PieceIndex, _disjoint, ("item_words", "budget", "distance"))


def _runs(rows: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """The keys of a table's rows with each distinct run (``run``) of their text, the last column."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(*columns: pa.Array):
        found = [run_keys(words(t), step) for t in columns[-1].to_pylist()]
        which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        yield {k: c.take(which) for k, c in zip(keys, columns)} | {"run": pa.array(np.concatenate(found), pa.int64())}

    return map_batches(rows, run, f"{kinds}, run bigint")


def _rarest(wanted: DataFrame, share: float) -> DataFrame:
    """The pieces of every item (``k``, ``t``): the runs that fewest items hold, one more than it may lack."""
    spread = materialize(_runs(wanted.select("k", F.xxhash64("t").alias("h"), "t"), ["k", "h"]), "item-runs")
    held = spread.groupBy("run").agg(F.count("*").alias("held"))
    per = spread.join(held, "run").groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("held", "run"))).alias("runs"))  # one item's runs
    size = F.size("runs")
    need = F.greatest(F.lit(1), F.ceil(size * F.lit(share))).cast("int")
    return per.select("k", "h", F.explode(F.slice("runs", F.lit(1), size - need + 1)["run"]).alias("run"))


def _disjoint(wanted: DataFrame) -> DataFrame:
    return _runs(wanted.select("k", F.xxhash64("t").alias("h"), "t"), ["k", "h"], RUN)


def _joined(picked: DataFrame, id_col: str, wanted: DataFrame, index_of, pieces: DataFrame, schema: str, counts: tuple[str, ...]) -> DataFrame:
    """Documents and items that meet in a piece, by a shuffle join of runs, then verified. Equal texts are joined once."""
    picked = picked.select(F.col(f"`{id_col}`").alias("__id"), "__text", F.md5("__text").alias("fp"))
    texts = picked.groupBy("fp").agg(F.first("__text").alias("__text"))
    meet = _runs(texts, ["fp"]).join(pieces, "run").select("fp", "k", "h").distinct()
    both = meet.join(wanted.withColumn("h", F.xxhash64("t")), ["k", "h"])
    both = both.join(picked, "fp").select("__id", "__text", "k", "t")

    def run(ids: pa.Array, texts: pa.Array, keys: pa.Array, items: pa.Array, held={}):  # noqa: B006 - the indexes of the batches before
        out = {c: [] for c in ("id", "item", *counts)}
        for i, text, k, t in zip(ids.to_pylist(), texts.to_pylist(), keys.to_pylist(), items.to_pylist()):
            if (k, t) not in held:
                if len(held) > 1000:
                    held.clear()
                held[k, t] = index_of([(k, t)])
            for hit in held[k, t].leaks(text):
                for c, v in zip(out, (i, *hit)):
                    out[c].append(v)
        yield out

    return map_batches(both, run, schema)


def _scan(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, index_of, pieces_of, counts: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    wanted = items.select(F.col(f"`{item_id}`").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).where(F.char_length("__text") > 0)
    schema = f"id {kind}, item {item_kind}, " + ", ".join(f"{c} int" for c in counts)
    total = wanted.agg(F.sum(F.char_length("t")).alias("n")).first().n or 0
    if total > PASS_CHARS:
        return _joined(picked, id_col, wanted, index_of, pieces_of(wanted), schema, counts).withColumnRenamed("id", id_col).withColumnRenamed("item", item_id)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(index_of([(r.k, r.t) for r in wanted.orderBy("k", "t").collect()])))  # PASS_CHARS at most

    def run(ids: pa.Array, texts: pa.Array, held={}):  # noqa: B006 - one index for all batches of a task
        if not held:
            held["index"] = pickle.loads(shared.value)
        index, out = held["index"], {c: [] for c in ("id", "item", *counts)}
        for i, text in zip(ids.to_pylist(), texts.to_pylist()):
            for hit in index.leaks(text):
                for c, v in zip(out, (i, *hit)):
                    out[c].append(v)
        yield out

    return map_batches(picked, run, schema).withColumnRenamed("id", id_col).withColumnRenamed("item", item_id)
