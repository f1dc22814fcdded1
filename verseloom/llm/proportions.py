"""A sample whose category shares match targets, by minimum-cost flow over cross-classified cell counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.operators.prefix import with_prefix_sums

#: Most rows in a table of targets, and most cells: with them, what the driver holds is bounded.
MOST_TARGETS, MOST_CELLS = 10_000, 200_000
#: Costs of a unit: beyond a cell's even part, beyond the other field's natural share, that a category lacks beyond its
#: minimum, and within it. Each outweighs any number of the ones before on a path.
UNEVEN, BESIDE, SHORT, SHORT_OF_FLOOR = 1, 100, 10**5, 10**7


def category_key(name: Column) -> Column:
    """Labels are one category if they differ only in letter case, surrounding spaces, spaces around ``/``, or in what
    parts words (one or more of space, ``_``, ``-``)."""
    parted = F.regexp_replace(F.lower(name), r"(?U)[\s\u00a0_\-]+", " ")
    return F.regexp_replace(F.trim(parted), r" ?/ ?", "/")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int, amount: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost >= 0)`` that carries ``amount`` (or as much as fits) at least cost.

    Primal-dual: distances by relaxing all residual arcs at once; then a maximum flow over the arcs of all shortest paths,
    by blocking flows in levels; so there are as many rounds as distinct path costs, not as many as paths."""
    table = np.array(arcs, np.int64).reshape(-1, 4)
    m = len(table)
    tail, head = np.concatenate([table[:, 0], table[:, 1]]), np.concatenate([table[:, 1], table[:, 0]])
    room, cost = np.concatenate([table[:, 2], np.zeros(m, np.int64)]), np.concatenate([table[:, 3], -table[:, 3]])
    far = np.int64(1 << 60)
    while amount > 0:
        dist = np.full(n, far)
        dist[source] = 0
        live = np.flatnonzero(room > 0)
        while True:
            before = dist.copy()
            reach = dist[tail[live]]
            np.minimum.at(dist, head[live], np.where(reach < far, reach + cost[live], far))
            if (dist == before).all():
                break
        if dist[sink] >= far:
            break
        tight = np.flatnonzero((dist[tail] < far) & (dist[tail] + cost == dist[head]))
        sent = _max_flow(n, tail[tight], head[tight], tight, room, m, source, sink, amount)
        amount -= sent
    return room[m:].tolist()


def _max_flow(n: int, tail: np.ndarray, head: np.ndarray, arc: np.ndarray, room: np.ndarray, m: int, source: int, sink: int, amount: int) -> int:
    """Send as much as fits over some residual arcs (numbered ``arc``; the reverse of e is e + m or e - m); updates ``room``."""
    sent = 0
    while sent < amount:
        level = np.full(n, -1, np.int64)
        level[source], depth = 0, 0
        open_ = room[arc] > 0
        while level[sink] < 0:
            reached = head[open_ & (level[tail] == depth)]
            reached = reached[level[reached] < 0]
            if not len(reached):
                return sent
            depth += 1
            level[reached] = depth
        use = np.flatnonzero(open_ & (level[head] == level[tail] + 1) & (level[tail] >= 0))
        use = use[np.argsort(tail[use], kind="stable")]
        ends = np.searchsorted(tail[use], np.arange(n + 1)).tolist()
        to, which, left = head[use].tolist(), arc[use].tolist(), room[arc[use]].tolist()
        full = list(left)
        at, path, x = ends[:-1].copy(), [], source
        while sent < amount:
            if x == sink:
                push = min(amount - sent, *(left[k] for k in path))
                sent += push
                for k in path:
                    left[k] -= push
                cut = next((i for i, k in enumerate(path) if not left[k]), len(path))
                x = to[path[cut - 1]] if cut else source
                del path[cut:]
                continue
            k, stop = at[x], ends[x + 1]
            while k < stop and not (left[k] and at[to[k]] <= ends[to[k] + 1]):
                k += 1
            at[x] = k
            if k < stop:
                path.append(k)
                x = to[k]
            elif not path:
                break
            else:
                at[x] = stop + 1  # a dead end
                x = source if len(path) == 1 else to[path[-2]]
                at[x] += 1
                path.pop()
        moved = np.array(full, np.int64) - np.array(left, np.int64)
        which_ = np.array(which, np.int64)
        room[which_] -= moved
        room[np.where(which_ < m, which_ + m, which_ - m)] += moved
    return sent


def cell_quotas(cells: dict[tuple, int], margin: int, goals: dict, floors: dict, seed: int = 7) -> tuple[dict[tuple, int], dict]:
    """Whole numbers to draw from each cell, and what each category of the margin lacks.

    ``cells``: available records by cross-classified categories; ``margin``: which part of a cell's key the ``goals`` and
    ``floors`` are for. A cell is an arc from its category of the margin to its category of the next field, so that both
    margins meet at the cells: source arcs carry the goals, cell arcs the availability (its even part of the goal first),
    the arcs to the sink the next field's natural share of the sample (beyond it at a cost), and slack arcs the shortfall.
    Which of equally good cells are filled is random.
    """
    rng = np.random.default_rng(seed)
    names = sorted(goals)
    used = [c for c in sorted(cells) if c[margin] in goals and cells[c] > 0]
    beside = (margin + 1) % len(used[0]) if used else margin
    other = (lambda c: c[beside]) if beside != margin else (lambda c: "")
    node = {c: i + 2 for i, c in enumerate(names)}
    meets = {b: i + 2 + len(names) for i, b in enumerate(sorted({other(c) for c in used}))}
    held, beside_held = dict.fromkeys(names, 0), dict.fromkeys(meets, 0)
    for c in used:
        held[c[margin]] += cells[c]
        beside_held[other(c)] += cells[c]
    arcs, what = [], []
    for c in names:
        floor = min(floors[c], goals[c])
        arcs += [(0, node[c], goals[c], 0), (node[c], 1, goals[c] - floor, SHORT), (node[c], 1, floor, SHORT_OF_FLOOR)]
        what += [None, ("short", c), ("short", c)]
    for k in rng.permutation(len(used)).tolist():
        cell = used[k]
        have = cells[cell]
        even = min(have, -(-have * goals[cell[margin]] // held[cell[margin]]))
        for part, price in ((even, 0), (have - even, UNEVEN)):
            if part:
                arcs.append((node[cell[margin]], meets[other(cell)], part, price))
                what.append(("cell", cell))
    drawn, total = sum(min(goals[c], held[c]) for c in names), sum(beside_held.values())
    for b, have in beside_held.items():
        natural = min(have, -(-drawn * have // total))
        arcs += [(meets[b], 1, natural, 0), (meets[b], 1, have - natural, BESIDE)]
        what += [None, None]
    flow = min_cost_flow(2 + len(names) + len(meets), arcs, 0, 1, sum(goals.values()))
    quotas: dict[tuple, int] = {}
    lacks = dict.fromkeys(names, 0)
    for f, w in zip(flow, what):
        if w and w[0] == "cell" and f:
            quotas[w[1]] = quotas.get(w[1], 0) + f
        elif w and w[0] == "short":
            lacks[w[1]] += f
    return quotas, lacks


def proportional_samples(df: DataFrame, id_col: str, fields: list[str], targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """For each field, a sample of its own whose categories reach their targets: ``(sample, report)``.

    ``targets``: ``field``, ``category``, ``target_permille``, ``min_count``, ``sample_permille``. The size of a sample is
    its permille of all records, rounded down; a category needs its permille of that size, rounded up, or ``min_count`` if
    that is more. sample: ``field``, id and ``category`` (as spelled in targets). report: a row per target with
    ``available``, ``needed``, ``drawn`` and ``lacking``.

    Records are cross-classified by all fields (categories without a target are one group), cells counted in Spark, cell
    quotas found by minimum-cost flow on the driver (at most ``MOST_CELLS`` cells), and quotas drawn at random by hash
    order, with distributed ranks, so that one cell may hold any part of the rows. ``id_col`` must be unique (see
    ``one_per_key``). Null, empty and untargeted labels fill no target but count for the size; ties are broken by id;
    an empty table draws nothing and lacks everything; other columns are ignored.
    """
    spark = df.sparkSession
    rules = targets.limit(MOST_TARGETS + 1).withColumn("key", category_key(F.col("category"))).collect()
    if len(rules) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if len({(r.field, r.key) for r in rules}) < len(rules) or any(v is None for r in rules for v in r):
        raise ValueError("a target that is repeated or has a null value")
    cats = [f"__c{i}" for i in range(len(fields))]
    coded = df.select(F.col(f"`{id_col}`").alias("__id"), *[category_key(F.col(f"`{f}`")).alias(f"__k{i}") for i, f in enumerate(fields)])
    for i, f in enumerate(fields):
        known = spark.createDataFrame([(r.key, r.category) for r in rules if r.field == f], f"__k{i} string, {cats[i]} string")
        coded = coded.join(F.broadcast(known), f"__k{i}", "left")  # at most MOST_TARGETS rows
    coded = coded.select("__id", *[F.coalesce(c, F.lit("")).alias(c) for c in cats])
    counted = coded.groupBy(*cats).count().limit(MOST_CELLS + 1).collect()
    if len(counted) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    cells = {tuple(r[c] for c in cats): r["count"] for r in counted}
    total = sum(cells.values())
    quota_rows, report_rows = [], []
    for i, f in enumerate(fields):
        mine = [r for r in rules if r.field == f]
        goals = {r.category: max(r.min_count, -(-r.target_permille * (r.sample_permille * total // 1000) // 1000)) for r in mine}
        quotas, lacks = cell_quotas(cells, i, goals, {r.category: r.min_count for r in mine}, seed + i)
        quota_rows += [(f, *cell, q) for cell, q in quotas.items()]
        for r in mine:
            have = sum(v for c, v in cells.items() if c[i] == r.category)
            report_rows.append((f, r.category, have, goals[r.category], goals[r.category] - lacks[r.category], lacks[r.category]))
    report = spark.createDataFrame(report_rows, "field string, category string, available bigint, needed bigint, drawn bigint, lacking bigint")
    quota_table = spark.createDataFrame(quota_rows, "field string, " + "".join(f"{c} string, " for c in cats) + "quota bigint")
    group = F.concat_ws("\u001f", "field", *cats)
    # one copy per sample; the quota table has at most MOST_CELLS rows a field
    spread = coded.join(F.broadcast(quota_table), cats).withColumn("__cell", group)
    spread = spread.withColumn("__key", F.xxhash64(F.lit(seed), "field", "__id")).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = with_prefix_sums(spread, "__cell", "__one", "__key", "__id", max(cells.values(), default=0)).where("__before < quota")
    own = F.coalesce(*[F.when(F.col("field") == f, F.col(c)) for f, c in zip(fields, cats)])
    return ranked.select("field", F.col("__id").alias(id_col), own.alias("category")), report
