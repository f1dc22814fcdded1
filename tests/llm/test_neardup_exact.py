import random

import numpy as np
import pytest

from tests.conftest import rows
from verseloom.llm import neardup as ND


def _records(seed: int, n: int = 60) -> list[tuple[int, str | None, str]]:
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.7:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh")
            texts.append("".join(t))
        else:
            texts.append("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60, 300))))
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(900, texts[0], "x"), (901, None, "x"), (902, "", "x"), (903, "short", "x"), (904, "short", "x")]


def _brute(data, threshold):
    keys = {i: ND.key_text([t]) for i, t, _ in data}
    sets = {i: {k[a : a + 9] for a in range(len(k) - 8)} for i, k in keys.items() if len(k) >= 9}
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_exact_mode_loses_no_pair(spark, threshold):
    data = _records(5)
    df = spark.createDataFrame(data, "k long, t string, rep string")
    near = ND.NearDuplicates(df, "k", ["t"], threshold, exact=True)
    assert sorted(rows(near.pairs().select("id_a", "id_b"))) == _brute(data, threshold)
    assert ND.NearDuplicates(df.limit(0), "k", ["t"], exact=True).pairs().count() == 0


def test_budget_prunes_strangers_early_and_keeps_the_similar():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (2000, ND.HASHES), dtype=np.uint64)
    budget = ND.error_budget(0.6)
    assert (np.diff(budget) >= 0).all() and budget[64] < 36 and budget[-1] < ND.BITS * 0.4
    sig = ND.signature_bits(base)
    order = np.lexsort([sig[:, w] for w in range(ND.WORDS - 1, -1, -1)])
    seen = {}
    assert sum(len(i) for i, _ in ND.trie_self_join(sig[order], [(0, 2000)], budget, seen)) < 20
    assert seen["pairs"] == 2000 * 1999 // 2 and seen["pruned"] > 0.999 * seen["pairs"] and seen["levels"] / seen["pruned"] < 130
    # records of which 60 % of the hash values are equal
    other = np.where(rng.random((2000, ND.HASHES)) < 0.6, base, rng.integers(0, 2**63, base.shape, dtype=np.uint64))
    pairs = 0
    for k in range(0, 2000, 100):
        sig = ND.signature_bits(np.concatenate([base[k : k + 100], other[k : k + 100]]))
        order = np.lexsort([sig[:, w] for w in range(ND.WORDS - 1, -1, -1)])
        pairs += sum(int((np.abs(order[i] - order[j]) == 100).sum()) for i, j in ND.trie_self_join(sig[order], [(0, 200)], budget))
    assert pairs >= 1998
