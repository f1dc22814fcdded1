import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from verseloom.llm import abuse as AB
from verseloom.llm import leaks as LK
from verseloom.llm import neardup as ND


def _edits(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice("xyz qw") + text[i + rng.randrange(2) :]
    return text


def _corpus(seed=1, groups=12, each=5):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(60))
        out += [_edits(rng, base, rng.choice([0, 1, 3, 8, 15])) for _ in range(each)]
    return [(i, f"t{i % 3}", t) for i, t in enumerate(out)] + [(900, None, None), (901, "", ""), (902, "ab", None), (903, "t0", out[0]), (904, "t0", out[0])]


def _brute(data, threshold):
    sets = {}
    for k, *parts in data:
        s = ND.key_text(list(parts))
        sets[k] = {s[i : i + 9] for i in range(len(s) - 8)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [4000, 3])
def test_pairs_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ND, "BLOCK", block)  # 3: every group is hot and cut into cells
    data = _corpus()
    df = spark.createDataFrame(data, "k long, title string, body string").selectExpr("*", "'x' AS rep", "1 AS size", "'y' AS band")
    nd = ND.NearDuplicates(df, "k", ["title", "body"], 0.6)
    got = rows(nd.pairs().select("id_a", "id_b"))
    assert set(got) == _brute(data, 0.6) and len(got) == len(set(got))
    classes = {r.k: r for r in nd.classes().collect()}
    parent = {k: k for k in classes}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: r.class_id for k, r in classes.items()} == {k: find(k) for k in classes}
    assert 900 not in classes and classes[903].copies == 3


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, t string")
    nd = ND.NearDuplicates(df, "k", ["t"])
    assert nd.pairs().count() == 0 and nd.classes().count() == 0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 60))
def test_trie_join_is_exact(seed, budget):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (8, ND.WORDS), dtype=np.uint64)
    w = np.repeat(base, 14, axis=0)
    for i in range(len(w)):
        for k in rng.integers(0, ND.WORDS * 64, rng.integers(0, 40)):
            w[i, k // 64] ^= np.uint64(1) << np.uint64(63 - k % 64)
    w = w[np.lexsort([w[:, k] for k in range(ND.WORDS - 1, -1, -1)])]
    got = [(int(i), int(j)) for x in ND.trie_self_join(w, [(0, len(w))], budget) for i, j in zip(*x)]
    differ = np.bitwise_count(w[:, None, :] ^ w[None, :, :]).sum(2)
    assert sorted(got) == [(i, j) for i in range(len(w)) for j in range(i + 1, len(w)) if differ[i, j] <= budget]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = dict(rows(ND.connected(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.lists(st.integers(0, 3), max_size=40))
def test_myers_distance(p, t):
    assert LK.passage_distance(p, t) == (_distance(p, t) if p else 0)


def test_leaks(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    items = [(i, "Read the passage and choose the answer. " + " ".join(word() for _ in range(30))) for i in range(6)] + [(6, "too short here"), (7, None), (0, "another text under the same id with enough words in it")]
    pieces = {i: t.split() for i, t in items[:6]}
    docs = [(1, "pre " + items[0][1] + " post"), (2, " ".join(pieces[1][:20])), (3, " ".join(pieces[1][:10])), (4, " ".join(pieces[2][20:] + ["gap"] + pieces[2][:20])), (5, None), (6, ""), (1, items[0][1]), (8, "x " * 20_000 + items[3][1].upper())]
    df = spark.createDataFrame(docs, "k long, t string").selectExpr("*", "1 AS item", "2 AS shared")
    ev = spark.createDataFrame(items, "item_id long, text string")

    def brute():
        from verseloom.llm._text import words

        grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
        return sorted((k, i) for k, t in docs for i, x in items if x and (g := grams(x)) and 2 * len(g & grams(t)) >= len(g))

    assert sorted(rows(LK.find_leaks(df, "k", "t", ev, "item_id", "text").select("k", "item_id"))) == brute()
    monkeypatch.setattr(LK, "PASS_CHARS", 300)  # several passes
    got = LK.find_leaks(df, "k", "t", ev, "item_id", "text")
    assert sorted(rows(got.select("k", "item_id"))) == brute()
    assert {r.distance for r in got.where("k = 1").collect()} == {0}
    assert LK.find_leaks(df.limit(0), "k", "t", ev, "item_id", "text").count() == 0 and LK.find_leaks(df, "k", "t", ev.limit(0), "item_id", "text").count() == 0


def _near(word, terms, errors):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y and x != "*"), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    return min(((d, t) for t in terms if (d := lev(word, t)) <= errors), default=(None, None))[1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc*", min_size=1, max_size=8), st.lists(st.text(alphabet="abc", min_size=1, max_size=8), min_size=1, max_size=12, unique=True), st.integers(0, 2))
def test_automaton_over_the_trie(word, terms, errors):
    assert AB.LexiconTrie(dict.fromkeys(terms, 1.0)).near(word, errors) == _near(word, terms, errors)


def test_disguises_are_read():
    trie = AB.LexiconTrie(dict.fromkeys(["moron", "rotten", "slut", "vollidiot", "fucking", "beaten", "filthy"], 1.0))
    r = AB.Reader(trie, frozenset({"motor"}))
    for text in ("You m.o.r.o.n", "you M O R O N", "m​o​r​o​n", "mooron", "m0r0n", "mor*n"):
        assert "moron" in r.windows(text)[0], text
    assert r.windows("r o t t e n s l u t")[0] == ["rotten", "slut"] and r.windows("V0ll1d10t")[0] == ["vollidiot"]
    assert r.windows("FUUUUCKING b****n fіlthy")[0] == ["fucking", "beaten", "filthy"] and r.windows("the motor")[0] == ["the", "motor"]


def _labelled(n, seed):
    rng = random.Random(seed)
    bad = ["You filthy moron, get out.", "All {} are vermin.", "Shut up, you idiot.", "I will shoot you, {}."]
    good = ["A court fined {} for calling a neighbour an idiot.", "Coders marked 'moron' as an insult in the codebook.", "The tribunal heard that {} were called vermin.", "The mayor of {} opened the harbor."]
    out = []
    for i in range(n):
        y = int(i % 5 == 0)
        body = [rng.choice(good).format(rng.choice(["Foo", "Bar", "Poe"])) for _ in range(3)]
        if y:
            body.insert(rng.randrange(4), rng.choice(bad).format(rng.choice(["Foo", "Bar"])))
        out.append((" ".join(body), y))
    return out


def test_scores_tell_abuse_from_reports(spark):
    model = AB.fit_abuse_model(_labelled(400, 1))
    held = _labelled(200, 2)
    right = sum((model.score(t)[0] >= 0.5) == bool(y) for t, y in held)
    assert right >= 190
    data = [(i, t) for i, (t, _) in enumerate(held)] + [(1000, None), (1001, ""), (1002, "You filthy m.o.r.o.n, get out. " + "The mayor opened the harbor. " * 3000), (None, "x"), (0, held[0][0])]
    df = spark.createDataFrame(data, "k long, t string").selectExpr("*", "1 AS score")
    got = AB.score_abuse(df, "k", "t", model)
    assert got.count() == len(data) and rows(got.where("k IN (1000, 1001)").select("hits", "flagged")) == [(0, False)] * 2
    assert rows(got.where("k = 1002").select("flagged")) == [(True,)]
    assert AB.score_abuse(df.limit(0), "k", "t", model).count() == 0


def test_without_labels_the_lexicon_decides(spark):
    model = AB.fit_abuse_model([])
    assert model.score("You idiot, you moron.")[0] > 0.5 > model.score("The harbor opened.")[0]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert AB.labelled_sample(docs, "doc_id", "text", labels, "toxic") == []


def test_short_terms_and_scripts_without_spaces_are_read():
    r = AB.Reader(AB.LexiconTrie(dict.fromkeys(["cunt", "kill", "笨蛋", "moron"], 1.0)), frozenset({"hill", "will"}))
    assert r.windows("cumt kiil")[0] == ["cunt", "kill"]  # one letter of four, the first one right
    assert r.windows("bill hill unt kil")[0] == ["bill", "hill", "unt", "kil"]
    assert r.windows("你是笨蛋吗")[0] == ["你", "是", "笨蛋", "吗"]


def test_batch_scores_equal_single_scores_and_count_features_once():
    model = AB.fit_abuse_model(_labelled(300, 4))
    texts = [t for t, _ in _labelled(60, 5)] + [None, "", "moron " * 100, "The mayor. " * 500 + "You filthy moron, get out."]
    scores, hits = model.scores(texts)
    assert [model.score(t) for t in texts] == [(float(s), int(h)) for s, h in zip(scores, hits)]
    assert hits[-2] == 100 and hits[-1] == 2 and scores[-4] == scores[-3] < 0.01

    def logit(window):  # plain: distinct words and pairs
        known = lambda w: model.vocabulary.get(w, -1)
        pairs = {known(a) << 32 | known(b) for a, b in zip(window, window[1:]) if known(a) >= 0 and known(b) >= 0}
        weight = dict(zip(model.pair_keys.tolist(), model.pair_weights.tolist()))
        return model.bias + sum(model.word_weights[known(w)] for w in set(window)) + sum(weight.get(p, 0.0) for p in pairs)

    for t, s in zip(texts, scores):
        want = max([logit(w) for w in model.reader.windows(t)], default=-30.0)
        assert s == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-9)


def test_model_is_saved_and_columns_kept(spark, tmp_path):
    model = AB.fit_abuse_model(_labelled(200, 6))
    AB.save_abuse_model(spark, model, f"{tmp_path}/model")
    df = spark.createDataFrame([(1, "You filthy moron, get out.", "a"), (1, "The mayor.", "b")], "k long, t string, source string")
    got = AB.score_abuse(df, "k", "t", AB.load_abuse_model(spark, f"{tmp_path}/model"), keep=["source"])
    assert sorted((r.k, r.source, r.flagged) for r in got.collect()) == [(1, "a", True), (1, "b", False)]
    assert [r.score for r in got.orderBy("source").collect()] == model.scores(["You filthy moron, get out.", "The mayor."])[0].tolist()
    with pytest.raises(ValueError):
        AB.score_abuse(df.withColumnRenamed("source", "score"), "k", "t", model, keep=["score"])


def test_lexicon_is_a_parameter():
    model = AB.fit_abuse_model([], lexicon={"insult": "blorp zonker"}, context=["court"])
    assert model.score("You blorp, you z0nker.")[0] > 0.5 > model.score("You idiot.")[0] and model.score("The court: blorp.")[0] < model.score("A blorp.")[0]
