import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from verseloom.operators.hierarchy import Hierarchy, first_parents


def brute(parent: dict) -> dict:
    out = {}
    for n in set(parent) | set(parent.values()):
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            cycle = seen[seen.index(x) :]
            out[n] = (min(cycle), -1, n in cycle)
        else:
            out[n] = (x, len(seen), False)
    return out


def check(spark, parent: dict) -> Hierarchy:
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    h = Hierarchy(df)
    got = {r.id: r for r in h.nodes.collect()}
    want = brute(parent)
    assert {k: (r.root, r.depth, r.in_cycle) for k, r in got.items()} == want
    tree = {k: r for k, r in got.items() if r.pre is not None}
    assert sorted(r.pre for r in tree.values()) == list(range(len(tree)))
    above = {}
    for n in tree:
        x = n
        while x in parent:
            x = parent[x]
            above.setdefault(x, set()).add(n)
    for k, r in tree.items():
        inside = {n for n, s in tree.items() if r.pre < s.pre <= r.last}
        assert inside == above.get(k, set()) and r.size == len(inside) + 1
    return h


def test_tree_cycle_tail_and_self(spark):
    parent = {"b": "a", "c": "a", "d": "b", "x": "y", "y": "z", "z": "y", "s": "s", "t": "s"}
    h = check(spark, parent)
    assert dict(rows(h.paths()))["d"] == "a/b/d"
    assert sorted(rows(h.descendants())) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 1)]
    some = spark.createDataFrame([("b",)], "id string")
    assert rows(h.descendants(some)) == [("b", "d", 1)]


def test_deep_chain_wide_parent_and_long_cycle(spark):
    parent = {f"n{i:03}": f"n{i - 1:03}" for i in range(1, 70)}
    parent |= {f"w{i:03}": "n000" for i in range(200)}
    parent |= {f"c{i}": f"c{(i + 1) % 13}" for i in range(13)} | {f"e{i}": (f"e{i - 1}" if i else "c5") for i in range(20)}
    check(spark, parent)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 40)
    check(spark, {f"{i:02}": f"{rng.randrange(n):02}" for i in rng.sample(range(n), rng.randrange(1, n))})


def test_first_parents_cleans_and_breaks_ties(spark):
    links = [(" A1 ", "B", 1, "x"), ("a1", "c", 0, "x"), ("a1", "C ", 0, "y"), ("a2", None, 0, None), ("a3", "q", None, ""), ("a3", "p", 5, ""), (None, "p", 0, ""), ("a4", " ", 0, ""), ("a5", "z", 0, ""), ("a5", "y", 0, "")]
    df = spark.createDataFrame(links, "child string, up string, o int, id string")  # an extra column that clashes
    assert rows(first_parents(df, "child", "up", "o"), "id") == [("a1", "c"), ("a3", "p"), ("a5", "y")]


def test_empty(spark):
    h = Hierarchy(spark.createDataFrame([], "id string, parent string"))
    assert h.nodes.count() == 0 and h.paths().count() == 0 and h.descendants().count() == 0


def test_prefix_sums_over_many_bins(spark, monkeypatch):
    from pyspark.sql import functions as F

    from verseloom.operators import prefix

    monkeypatch.setattr(prefix, "BIN_ROWS", 5)
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("g"), "id", F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("w"))
    got = rows(prefix.with_prefix_sums(df, "g", "w", "k", "id", 400))
    for g in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in got if r[0] == g), key=lambda r: (r[2], r[1])):
            assert r[4] == total
            total += r[3]


@pytest.mark.parametrize("bad", [{"id": None}])
def test_null_ids_are_left_out(spark, bad):
    h = Hierarchy(spark.createDataFrame([(None, "a"), ("b", None), ("c", "b")], "id string, parent string"))
    assert rows(h.nodes.select("id", "depth"), "id") == [("b", 0), ("c", 1)]
