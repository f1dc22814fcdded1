"""Near-duplicate records with small edits: a Hamming self-join of bit signatures by binary tries.

A record's key text (letters and digits of its cleaned fields) gives the set of its runs of nine characters, the set a
MinHash of ``HASHES`` values, and the low bits of those a bit signature: records of similarity s differ in about
``BITS * (1 - s) / 2`` bits. Signatures are kept in ``BANDS`` arrangements, each with another band of hash values first,
as the leading levels of the trie. A trie self-join with no error allowed in the leading band and an error budget over
the signature is then a shuffle by the band and, for each band value, a traversal of pairs of trie nodes that adds up
differing bits and prunes. The budget grows with the depth, so that most pairs that only share a band are pruned in the
first levels. What is left is held exactly against the similarity of the sets.

No error at all may fall into a leading band, which is why a pair can be missed by all of them; ``exact=True`` takes the
rarest runs of each set in place of the bands, enough of them that a similar pair must share one, and no budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm._text import NOT_WORD, cleaned
from verseloom.operators.graph import connected
from verseloom.runtime import drop_materialized, map_batches, materialize, pretty_size

#: Characters in a run.
RUN = 9
#: Hash values in a leading band, and bands. At similarity 0.6 a pair meets in one of them with probability 1 - (1 - 0.6**3)**30 = 0.9993.
BAND_HASHES, BANDS = 3, 30
HASHES = BAND_HASHES * BANDS
#: Low bits of each hash value in the signature.
HASH_BITS = 3
BITS = HASHES * HASH_BITS
WORDS = -(-BITS // 64)
#: Records of one band value that one task joins; beyond that the group is cut into cells of pairs of such blocks.
BLOCK = 4000
#: Pairs of trie nodes held at a time; more are put on a stack.
FRONTIER = 400_000

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEEDS = ((np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)


def error_budget(similarity: float) -> np.ndarray:
    """Differing bits allowed in the first d bits, for each depth d of the trie: the mean at ``similarity`` and five
    standard deviations (a hash value that differs has each of its bits differ or not, so they vary together)."""
    depth = np.minimum(np.arange(WORDS * 64 + 1), BITS)
    miss, hashes = 1 - similarity, -(-depth // HASH_BITS)
    spread = (hashes * miss * similarity * (HASH_BITS / 2) ** 2 + depth * miss / 4) ** 0.5
    return np.minimum(depth, depth * miss / 2 + 5 * spread).astype(np.int64)


def key_text(parts: list[str | None]) -> str:
    """Letters and digits of the cleaned fields."""
    return NOT_WORD.sub("", cleaned(" ".join(p or "" for p in parts)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def run_hashes(text: str, run: int = RUN) -> np.ndarray:
    """Distinct hashes of all runs of ``run`` consecutive characters."""
    if len(text) < run:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - run + 1
    h = points[:n].copy()
    for k in range(1, run):
        h *= np.uint64(0x100000001B3)
        h += points[k : k + n]
    h = _mix(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def min_hashes(runs: np.ndarray) -> np.ndarray:
    """The MinHash of a non-empty set, in blocks so that a very long text needs no more memory."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    high = (runs >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(high), 4096):
        x = high[a : a + 4096][None, :] * _SEEDS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=1), out=least)
    return _mix(least.astype(np.uint64) + np.uint64(1))


def signature_bits(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` 64-bit words per record; the first bit of the trie is the top bit of word 0."""
    bits = ((hashes[:, :, None] >> np.arange(HASH_BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(len(hashes), -1)
    packed = np.zeros((len(hashes), WORDS * 8), np.uint8)
    packed[:, : -(-BITS // 8)] = np.packbits(bits, axis=1)
    return packed.view(">u8").astype(np.uint64)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit value per record and band; the band's number is mixed in."""
    out = np.zeros((len(hashes), BANDS), np.uint64)
    for k in range(BAND_HASHES):
        out = _mix(out ^ hashes[:, k::BAND_HASHES])
    return _mix(out ^ np.arange(1, BANDS + 1, dtype=np.uint64)[None, :])


def trie_self_join(words: np.ndarray, groups: list[tuple[int, int]] | np.ndarray, budget: np.ndarray | int, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, within each group, whose first d bits differ in ``budget[d]`` bits at most, for every depth d (or in one
    budget at every depth).

    ``words``: signatures, sorted within each group ``[lo, hi)``, so that a range of rows that agree in the first d bits
    is a node at depth d of the group's binary trie. Pairs of nodes are traversed together, level by level: children on
    equal bits keep the errors, children on unequal bits add one, and a pair over the budget is pruned. All groups go
    down at once in vectors; a frontier that grows too long is cut and the rest waits on a stack. Paths are compressed: two
    nodes of one row each have no branches left and go down a word at a time. ``seen`` counts ``pairs`` of rows, those
    ``pruned`` above the last level, and the ``levels`` at which they were, summed.
    """
    groups = np.asarray(groups, np.int64).reshape(-1, 2)
    n_bits = words.shape[1] * 64
    ones: dict[int, np.ndarray] = {}
    seen = {} if seen is None else seen
    budget = np.full(n_bits + 1, budget) if np.ndim(budget) == 0 else budget

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            if len(ones) > 8:
                ones.pop(next(iter(ones)))
            bit = (words[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return ones[depth]

    def pruned(pairs: int, depth: int) -> None:
        seen["pruned"] = seen.get("pruned", 0) + pairs
        seen["levels"] = seen.get("levels", 0) + pairs * depth

    def leaves(f: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = f[:, 0], f[:, 2]
        differ = np.zeros(len(i), np.int64)
        for w in range(words.shape[1]):
            differ += np.bitwise_count(words[i, w] ^ words[j, w])
            near = differ <= budget[64 * (w + 1)]
            if not near.all():
                if w + 1 < words.shape[1]:
                    pruned(int((~near).sum()), max(depth, 64 * (w + 1)))
                i, j, differ = i[near], j[near], differ[near]
        return i, j

    def spread(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At the last level, all pairs under a pair of nodes: rows with equal signatures."""
        a, b, c, d = f[:, :4].T
        wide = d - c
        total = (b - a) * wide
        which = np.repeat(np.arange(len(total)), total)
        k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
        i, j = a[which] + k // wide[which], c[which] + k % wide[which]
        keep = (a[which] != c[which]) | (i < j)
        return i[keep], j[keep]

    rows_of = lambda f: np.where(f[:, 0] == f[:, 2], (f[:, 1] - f[:, 0]) * (f[:, 1] - f[:, 0] - 1) // 2, (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2]))
    start = np.column_stack([groups, groups, np.zeros(len(groups), np.int64)])
    seen["pairs"] = seen.get("pairs", 0) + int(rows_of(start).sum())
    stack = [(0, start)]
    while stack:
        depth, f = stack.pop()
        while len(f):
            if len(f) > FRONTIER:
                stack.append((depth, f[len(f) // 2 :]))
                f = f[: len(f) // 2]
                continue
            if depth == n_bits:
                for at in range(0, len(f), 20_000):
                    yield spread(f[at : at + 20_000])
                break
            single = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
            if single.any():
                yield leaves(f[single & (f[:, 0] != f[:, 2])], depth)
                f = f[~single]
                if not len(f):
                    break
            before = ones_before(depth)
            a, b, c, d, e = f.T
            p, q = b - (before[b] - before[a]), d - (before[d] - before[c])  # where the ones begin
            same = a == c  # a node with itself: its two children meet once
            parts = [np.column_stack(x) for x in ((a, p, c, q, e), (p, b, q, d, e), (a, p, q, d, e + 1), (p, b, c, q, e + 1))]
            parts[3] = parts[3][~same]
            f = np.concatenate(parts)
            f = f[(f[:, 1] > f[:, 0]) & (f[:, 3] > f[:, 2])]
            depth += 1
            over = f[:, 4] > budget[depth]
            if over.any():
                pruned(int(rows_of(f[over]).sum()), depth)
                f = f[~over]


def _signatures(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(ids: pa.Array, *texts: pa.Array):
        import hashlib

        keys = [key_text(list(parts)) for parts in zip(*(t.to_pylist() for t in texts))]
        hashes = np.zeros((len(keys), HASHES), np.uint64)
        sizes = []
        for k, key in enumerate(keys):
            runs = run_hashes(key)
            sizes.append(len(runs))
            if len(runs):
                hashes[k] = min_hashes(runs)
        sig, bands = signature_bits(hashes), band_values(hashes)
        yield {
            "id": ids, "key": keys, "fp": [hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys], "size": sizes,
            "sig": [s.astype(">u8").tobytes() for s in sig], "bands": list(bands.view(np.int64)),
        }

    picked = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`").cast("string").alias(f"__{k}") for k, c in enumerate(text_cols)])
    return map_batches(picked, run, f"id {kind}, key string, fp binary, size int, sig binary, bands array<bigint>")


def _candidates(reps: DataFrame, budget: np.ndarray, threshold: float) -> DataFrame:
    """Pairs of representatives that the trie self-join leaves, each once; sets of too unequal size can't be similar enough."""
    kind = reps.schema["rep"].dataType.simpleString()
    rows = reps.select(F.explode("bands").alias("band"), "rep", "sig", "size")
    # groups too large for one task are cut into blocks; each pair of blocks is a cell of its own
    large = rows.groupBy("band").count().where(F.col("count") > BLOCK).select("band", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = materialize(large, "hot-bands")
    any_large = bool(large.limit(1).count())
    if not any_large:
        drop_materialized(large)
    if any_large:
        hot = F.broadcast(large) if pretty_size(large) < 8 << 20 else large
        rows = rows.join(hot, "band", "left")
        mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.select("band", "rep", "sig", "size", "blocks", F.coalesce(mine, F.lit(0)).alias("side"), F.explode(others).alias("other"))
        cell = F.coalesce(F.least("side", "other").cast("bigint") * F.col("blocks") + F.greatest("side", "other"), F.lit(0).cast("bigint"))
        rows = rows.select("band", cell.alias("cell"), "rep", "sig", "size", "side", (F.col("side") == F.col("other")).alias("whole"))
    else:
        rows = rows.select("band", F.lit(0).cast("bigint").alias("cell"), "rep", "sig", "size", F.lit(0).alias("side"), F.lit(True).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
            band, cell = t["band"].to_numpy(), t["cell"].to_numpy()
            change = np.flatnonzero((band[1:] != band[:-1]) | (cell[1:] != cell[:-1])) + 1
            lo, hi = np.concatenate([[0], change]), np.concatenate([change, [len(band)]])
            many = hi - lo > 1
            if not many.any():
                return
            groups = np.column_stack([lo, hi])[many]
            keep = np.concatenate([np.arange(a, b) for a, b in groups])
            sizes = groups[:, 1] - groups[:, 0]
            ends = np.cumsum(sizes)
            t = t.take(pa.array(keep))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), ">u8").astype(np.uint64).reshape(len(keep), WORDS)
            group = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort([*(sig[:, w] for w in range(WORDS - 1, -1, -1)), group])
            sig, reps_ = sig[order], t["rep"].take(pa.array(order))
            sides, whole, sizes_ = t["side"].to_numpy()[order], t["whole"].to_numpy()[order], t["size"].to_numpy()[order]
            for i, j in trie_self_join(sig, np.column_stack([ends - sizes, ends]), budget):
                # in a cell of two blocks, pairs within a block belong to the block's own cell
                due = (whole[i] | (sides[i] != sides[j])) & (np.minimum(sizes_[i], sizes_[j]) >= np.maximum(sizes_[i], sizes_[j]) * threshold)
                i, j = i[due], j[due]
                if len(i):
                    x, y = reps_.take(pa.array(i)), reps_.take(pa.array(j))
                    yield from pa.table({"a": x, "b": y}).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:  # sorted by band and cell: join whole groups, a bounded number of rows at a time
            held.append(b)
            size += b.num_rows
            if size >= 200_000:
                t = pa.Table.from_batches(held)
                band, cell = t["band"].to_numpy(), t["cell"].to_numpy()
                other = np.flatnonzero((band != band[-1]) | (cell != cell[-1]))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from join(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = len(band) - cut
        if held:
            yield from join(pa.Table.from_batches(held))

    grouped = rows.repartition("band", "cell").sortWithinPartitions("band", "cell")
    pairs = grouped.mapInArrow(run, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest_runs(records: DataFrame, threshold: float) -> DataFrame:
    """``bands`` of the exact join: of n runs the n - ⌈threshold·n⌉ + 1 that fewest records hold (ties by hash). Two sets of
    at least that similarity share one of them."""
    kind = records.schema["rep"].dataType.simpleString()

    def run(reps: pa.Array, keys: pa.Array):
        for r, k in zip(reps, keys.to_pylist()):
            runs = run_hashes(k).view(np.int64)
            yield {"rep": pa.array([r.as_py()] * len(runs), reps.type), "run": runs}

    spread = materialize(map_batches(records.select("rep", "key"), run, f"rep {kind}, run bigint"), "runs")
    held = spread.groupBy("run").agg(F.count("*").alias("held")).where("held > 1")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "run")))
    # as many runs as one text has, whatever the size of the table
    per = spread.join(held, "run", "left").groupBy("rep").agg(ordered.alias("runs"))
    size = F.size("runs")
    first = F.slice("runs", 1, (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int"))
    bands = per.select("rep", F.transform(F.filter(first, lambda r: r["held"] > 1), lambda r: r["run"]).alias("bands"))
    return records.select("rep", "sig", "size").join(bands, "rep")


class NearDuplicates:
    """Near-duplicate records of a table.

    ``members``: id and ``rep``, the least id with exactly the same key text. ``links``: pairs of representatives
    ``a < b`` with their exact ``similarity``, ``threshold`` at least. Both are tables in the shared folder.

    ``id_col`` must be unique (see ``one_per_key``); rows with a null id are left out. Null fields count as empty; a key
    text of fewer than nine characters has no runs, so it is like nothing else, not even its own copies. Copies are
    joined once, by their representative. Other columns are ignored; an empty table gives empty results. ``exact``: lose no
    pair, at the price of a shuffle of some ``1 - threshold`` of all runs in place of ``BANDS`` values a record.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.6, exact: bool = False):
        self.id_col, self.threshold = id_col, threshold
        self.kind = docs.schema[id_col].dataType.simpleString()
        signed = materialize(_signatures(docs, id_col, text_cols), "signatures").where("size > 0")
        least = signed.groupBy("fp").agg(F.min("id").alias("rep"))
        self.members = materialize(signed.select("id", "fp").join(least, "fp").select("id", "rep"), "members")
        reps = self.members.where("id = rep").select("rep")
        signed = signed.withColumnRenamed("id", "rep")
        chosen = signed.join(reps, "rep", "left_semi")
        if exact:
            chosen, budget = _rarest_runs(chosen, threshold), np.arange(WORDS * 64 + 1)
        else:
            budget = error_budget(threshold)
        pairs = materialize(_candidates(chosen.select("rep", "sig", "bands", "size"), budget, threshold), "candidates")
        self.links = materialize(self._verified(pairs, signed.select("rep", "key")), "links")
        drop_materialized(pairs)  # members and links are all that is read from here on
        drop_materialized(signed)

    def _verified(self, pairs: DataFrame, keys: DataFrame) -> DataFrame:
        threshold = self.threshold
        both = pairs.join(keys.withColumnsRenamed({"rep": "a", "key": "ka"}), "a").join(keys.withColumnsRenamed({"rep": "b", "key": "kb"}), "b").select("a", "b", "ka", "kb")

        def run(a: pa.Array, b: pa.Array, ka: pa.Array, kb: pa.Array):
            sims = []
            for s, t in zip(ka.to_pylist(), kb.to_pylist()):
                p, q = ({s[i : i + RUN] for i in range(len(s) - RUN + 1)} for s in (s, t))
                common = len(p & q)
                sims.append(common / (len(p) + len(q) - common))
            keep = pa.array([v >= threshold for v in sims])
            yield {"a": a.filter(keep), "b": b.filter(keep), "similarity": pa.array(sims, pa.float64()).filter(keep)}

        return map_batches(both, run, f"a {self.kind}, b {self.kind}, similarity double")

    def pairs(self) -> DataFrame:
        """All pairs of ids, ``id_a < id_b``, with their similarity: links between representatives and pairs of copies,
        expanded to the members."""
        m, kind = self.members, self.kind
        one = m.select(F.col("id").alias("x"), F.col("rep").alias("a"))
        two = m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        linked = self.links.join(one, "a").join(two, "b").select("x", "y", "similarity")
        copied = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        both = linked.unionByName(copied)
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def classes(self) -> DataFrame:
        """One row per record: id, ``class_id`` (the least id of its connected class), ``copies`` (records with exactly its
        key text) and ``links`` (different texts similar to it)."""
        label = connected(self.links.select("a", "b"))
        count = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        per = copies.join(count, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
        return self.members.join(per, "rep").select(F.col("id").alias(self.id_col), F.coalesce("label", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
