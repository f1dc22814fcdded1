import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from verseloom.llm import mix as X
from verseloom.llm import proportions as P
from verseloom.llm.terms import distinctive_terms, term_frequencies
from verseloom.runtime import one_per_key


def test_distinctiveness(spark):
    docs = {1: "red red blue", 2: "blue green", 3: "Red­ 42 é", 4: None, 5: ""}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "k long, t string, term string")
    got = {(r.k, r.term): r for r in distinctive_terms(df, "k", "t").collect()}
    tokens = {1: ["red", "red", "blue"], 2: ["blue", "green"], 3: ["red", "é"]}
    total, n = Counter(itertools.chain(*tokens.values())), 7
    assert set(got) == {(k, w) for k, ws in tokens.items() for w in ws}
    for (k, w), r in got.items():
        a = tokens[k].count(w)
        t = [[a, total[w] - a], [len(tokens[k]) - a, n - len(tokens[k]) - total[w] + a]]
        want = 2 * sum(o * math.log(o * n / (sum(t[i]) * (t[0][j] + t[1][j]))) for i in (0, 1) for j in (0, 1) if (o := t[i][j]))
        assert r.llr == pytest.approx(want, abs=1e-9) and r.over == (a * (n - len(tokens[k])) > (total[w] - a) * len(tokens[k]))
    assert rows(distinctive_terms(df, "k", "t", min_tf=2, min_records=2).select("k", "term", "tf", "records")) == [(1, "red", 2, 2)]
    assert distinctive_terms(df.limit(0), "k", "t").count() == 0


def test_frequencies_and_marks(spark):
    data = [(i, "the common", f"the w{chr(97 + i % 5)}" + (" once" if i == 3 else "")) for i in range(20)] + [(20, None, None), (21, "", "x " * 50_000)]
    df = spark.createDataFrame(data, "k long, title string, t string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(df, "k", ["title", "t"]).collect()}
    assert got["the"] == (40, 20, "common") and got["wa"] == (4, 4, None) and got["once"] == (1, 1, "rare") and got["x"] == (50_000, 1, "rare")
    assert term_frequencies(df.limit(0), "k", ["title", "t"]).count() == 0


def test_one_per_key_takes_the_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (None, "c", 3), (2, None, None)], "k long, t string, at int")
    assert rows(one_per_key(df, ["k"], ["t"], "at"), "k") == [(1, "b"), (2, None)]


def test_category_key(spark):
    names = ["Asia/Pacific", " asia / pacific ", "ASIA/PACIFIC", "sport_events", "Sport  Events", "sport-events", None]
    keys = [r[0] for r in spark.createDataFrame([(n,) for n in names], "c string").select(P.category_key(F.col("c"))).collect()]
    assert keys == ["asia/pacific"] * 3 + ["sport events"] * 3 + [None]


def test_min_cost_flow_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        n, arcs = 4, []
        for a, b in itertools.permutations(range(4), 2):
            if rng.random() < 0.6 and b != 0 and a != 3:
                arcs.append((a, b, rng.randrange(3), rng.randrange(5)))
        want = None
        for flow in itertools.product(*[range(c + 1) for *_, c, _ in arcs]) if len(arcs) < 9 else []:
            net = [0] * n
            for f, (a, b, *_x) in zip(flow, arcs):
                net[a] -= f
                net[b] += f
            if net[1] == net[2] == 0:
                best = (-net[3], sum(f * a[3] for f, a in zip(flow, arcs)))
                want = best if want is None or best < want else want
        if want:
            flow = P.min_cost_flow(n, arcs, 0, 3, 99)
            sent = sum(f for f, a in zip(flow, arcs) if a[1] == 3)
            assert (-sent, sum(f * a[3] for f, a in zip(flow, arcs))) == want


def test_flow_at_the_bound_of_cells_keeps_both_margins():
    rng = random.Random(3)
    cells = {(f"a{i}", f"b{j}"): rng.randrange(1, 60) for i in range(450) for j in range(440)}  # 198,000 of MOST_CELLS
    goals = {f"a{i}": 40 + 20 * (i % 7) for i in range(450)} | {"gone": 9}
    began = time.perf_counter()
    quotas, lacks = P.cell_quotas(cells, 0, goals, dict.fromkeys(goals, 5))
    took = time.perf_counter() - began
    assert all(0 < q <= cells[c] for c, q in quotas.items()) and lacks == dict.fromkeys(goals, 0) | {"gone": 9}
    drawn, beside, have = Counter(), Counter(), Counter()
    for (a, b), q in quotas.items():
        drawn[a] += q
        beside[b] += q
    for (_, b), n in cells.items():
        have[b] += n
    total, all_ = sum(drawn.values()), sum(have.values())
    assert drawn == {a: g for a, g in goals.items() if a != "gone"}
    assert all(beside[b] <= -(-total * n // all_) for b, n in have.items())  # the other field keeps its shares
    assert took < 60, took


def test_the_other_field_is_kept_as_far_as_cells_allow():
    # x can be drawn from both, y only from p: the flow leaves p to y, which a star per category wouldn't
    quotas, lacks = P.cell_quotas({("x", "p"): 50, ("x", "q"): 50, ("y", "p"): 50}, 0, {"x": 50, "y": 50}, {"x": 0, "y": 0})
    assert lacks == {"x": 0, "y": 0} and quotas[("y", "p")] == 50 and quotas[("x", "q")] >= 33


def test_samples_reach_targets_and_report(spark):
    data = [(i, "a" if i < 300 else " A " if i < 320 else "b_c" if i < 350 else None, "x/y" if i % 3 else "X / Y") for i in range(400)]
    df = spark.createDataFrame(data, "k long, f string, g string")
    targets = spark.createDataFrame([("f", "a", 500, 5, 500), ("f", "b c", 400, 5, 500), ("f", "none", 1, 3, 500), ("g", "x/y", 1000, 1, 100)], "field string, category string, target_permille long, min_count long, sample_permille long")
    sample, report = P.proportional_samples(df, "k", ["f", "g"], targets)
    r = {(x.field, x.category): (x.available, x.needed, x.drawn, x.lacking) for x in report.collect()}
    assert r == {("f", "a"): (320, 100, 100, 0), ("f", "b c"): (30, 80, 30, 50), ("f", "none"): (0, 3, 0, 3), ("g", "x/y"): (400, 40, 40, 0)}
    counts = {(x.field, x.category): x["count"] for x in sample.groupBy("field", "category").count().collect()}
    assert counts == {("f", "a"): 100, ("f", "b c"): 30, ("g", "x/y"): 40}
    assert sample.select("field", "k").distinct().count() == sample.count()
    empty, report = P.proportional_samples(df.limit(0), "k", ["f", "g"], targets)
    assert empty.count() == 0 and report.where("lacking = needed").count() == 4
    with pytest.raises(ValueError):
        P.proportional_samples(df, "k", ["f"], targets.unionByName(targets))


def test_mix_cuts_at_the_budget(spark):
    data = [(i, "Big" if i < 400 else " big " if i < 420 else "small" if i < 430 else None, "t" * (i % 7 + 1)) for i in range(460)] + [(900, "small", None), (901, "small", "é" * 20_000), (901, "small", "z")]
    df = spark.createDataFrame(data, "k long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("BIG", 300, 1, 100), ("Small", 100, 2, 100), ("gone", 100, 3, 100)], "source string, target_permille long, max_repeats long, budget_permille long")
    mix, report = X.mix_sources(df, targets, "k", "source", X.byte_tokens(F.col("text")))
    total = sum(len((t or "").encode()) for *_, t in data)
    budget = total * 100 // 1000
    r = {x.source: x for x in report.collect()}
    big = sum(len(t) for _, s, t in data if s and s.strip().lower() == "big")
    assert r["BIG"].available == big and r["BIG"].reached - min(0.3 * budget, big) < 7 and r["BIG"].reached >= min(0.3 * budget, big) and r["gone"].short and r["gone"].reached == 0
    assert r["BIG"].short == (1000 * big < 300 * budget) and r["Small"].copies_most <= 2
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-9
    assert mix.where("copies < 1").count() == 0
    none, rep = X.mix_sources(df.limit(0), targets, "k", "source", X.byte_tokens(F.col("text")))
    assert none.count() == 0 and rep.where("reached = 0").count() == 3


def test_mix_repeats_whole_epochs(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b", "x" * 10) for i in range(110)], "k long, source string, text string")
    targets = spark.createDataFrame([("a", 250, 3, 1000), ("b", 500, 1, 1000)], "source string, target_permille long, max_repeats long, budget_permille long")
    mix, report = X.mix_sources(df, targets, "k", "source", X.byte_tokens(F.col("text")))
    r = {x.source: (x.reached, x.short) for x in report.collect()}
    assert r == {"a": (280, False), "b": (550, False)} and {x.copies for x in mix.where("source = 'a'").collect()} == {2, 3}
