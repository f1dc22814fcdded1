"""The pN_method queries run their problem's named method over the whole table."""

import math
import random
from collections import Counter

import pytest

from verseloom.llm import queries as Q
from verseloom.llm._text import terms, words


def test_p2_method_scores_every_term(spark):
    at = "/root/testdata/sf0.001"
    names = [n for n in Q.QUERIES if n.startswith("p2_")]
    assert names[0] == "p2_method"
    texts = {r.article_id: r.text for r in Q._articles(spark, at, "text").collect()}
    counts = {k: Counter(terms(t)) for k, t in texts.items()}
    total, n = sum(counts.values(), Counter()), sum(sum(c.values()) for c in counts.values())
    got = {(r.article_id, r.term): r for r in Q.QUERIES["p2_method"](spark, at).collect()}
    assert set(got) == {(k, w) for k, c in counts.items() for w in c}
    for (k, w), r in got.items():
        a, here = counts[k][w], sum(counts[k].values())
        t = [[a, total[w] - a], [here - a, n - here - total[w] + a]]
        want = 2 * sum(o * math.log(o * n / (sum(t[i]) * (t[0][j] + t[1][j]))) for i in (0, 1) for j in (0, 1) if (o := t[i][j]))
        assert r.tf == a and r.total == total[w] and r.llr == pytest.approx(max(0.0, want), abs=1e-6)


def _distance(item, text):
    """Edit distance in words of the item to the best passage, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j - 1] + (x != w), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_p8_method_verifies_by_distance(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = {i: ["choose", "the", "one", "best", "answer"] + [word() for _ in range(n)] for i, n in enumerate((25, 30, 17, 3, 0, 40))}
    docs = [None, "", "choose the one best answer", " ".join(items[0][15:] + items[0][:15])]  # halves in another order
    for own in items.values():
        for edits in range(9):
            w = list(own)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            docs.append(" ".join([word() for _ in range(rng.randrange(9))] + w + [word()]))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(90, "too short"), (91, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.budget, r.distance) for r in Q.QUERIES["p8_method"](spark, str(tmp_path)).collect()}
    every = {(d, k): (len(v) // 5 - 1, _distance(v, words(t))) for d, t in enumerate(docs) for k, v in items.items()}
    assert got == {x: (b, n) for x, (b, n) in every.items() if n <= b}
    assert (3, 0) not in got and (3, 0) in {(r.doc_id, r.item_id) for r in Q.QUERIES["p8_found"](spark, str(tmp_path)).collect()}
    assert any(n for _, n in got.values()) and next(n for n in Q.QUERIES if n.startswith("p8_")) == "p8_method"


def test_p8_method_joins_many_items_by_a_shuffle(spark, monkeypatch):
    from verseloom.llm import leaks as LK

    rng = random.Random(11)
    item = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(n))
    items = [(i % 25, "choose the one best answer " + item(rng.randrange(40))) for i in range(30)] + [(70, None), (71, "too short")]
    docs = [(i, " ".join([item(3), *(t or "").split()[rng.randrange(3) :], item(2)])) for i, (_, t) in enumerate(items * 2)] + [(1, items[0][1]), (99, None), (98, "")]
    df, ev = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(items, "k long, t string")
    for find in (LK.find_leaks, LK.find_passages):
        monkeypatch.setattr(LK, "PASS_CHARS", 2_000_000)
        ev2 = ev.withColumnRenamed("k", "item")
        want = sorted(map(tuple, find(df, "k", "t", ev2, "item", "t").collect()))
        monkeypatch.setattr(LK, "PASS_CHARS", 10)
        assert want and sorted(map(tuple, find(df, "k", "t", ev2, "item", "t").collect())) == want
