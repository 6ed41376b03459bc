import random
from collections import defaultdict

import cases
import numpy as np
import pytest

from sievewright.llm import mixing


def test_targets():
    assert mixing.fill_targets(np.array([10, 10, 10]), np.array([1., 1., 1.])).tolist() == [10, 10, 10]
    capped = mixing.fill_targets(np.array([1, 50, 49]), np.array([5., 2., 1.]))
    assert capped[0] == 3 and capped.sum() == pytest.approx(100) and capped[1] == pytest.approx(2 * capped[2])
    assert mixing.fill_targets(np.array([0, 0]), np.array([5., 2.])).tolist() == [0, 0]


def test_tree_deals_every_draw_once():
    quotas = np.array([37, 0, 5, 120])
    for shards in (1, 2, 7, 64):
        leaves = [mixing.split_quotas(quotas, shards, s, 3) for s in range(shards)]
        for source, quota in enumerate(quotas):
            ranges = sorted((int(a[source]), int(n[source])) for a, n in leaves if n[source])
            assert [a for a, _ in ranges] == list(np.cumsum([0] + [n for _, n in ranges])[:-1]) and sum(n for _, n in ranges) == quota
        totals = [int(n.sum()) for _, n in leaves]
        assert max(totals) - min(totals) <= shards.bit_length()


def table(spark, n=400):
    rng = random.Random(1)
    rows = [(k, cases.prose(rng, rng.randrange(0, 60)), f"s{0 if k % 3 else k % 7}") for k in range(n)]
    return rows + [(900, "a b c", None), (901, None, None), (902, "", "s1"), (903, "x y", "s2"), (903, "x y", "s2"), (None, "p q r", "s2")]


def test_taken_words(spark):
    rows = table(spark)
    docs = cases.documents(spark, rows)
    found = mixing.Mixer(docs, blocks=16, shards=8).per_document().collect()
    again = mixing.Mixer(cases.documents(spark, rows, 3), blocks=16, shards=8).per_document().collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size, taken, about = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] in [len(cases.words(x[1])) for x in rows if x[0] == r["doc_id"]]
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        about[s] = (r["source_size"], r["target"])
    names = sorted(size, key=lambda s: (s is None, s))
    targets = mixing.fill_targets(np.array([size[s] for s in names]), np.array([mixing.WEIGHTS[i % 3] for i in range(len(names))]))
    for s, target in zip(names, targets):
        assert about[s][0] == size[s] and about[s][1] == pytest.approx(target)
        assert abs(taken[s] - target) <= 2


def test_mix_gives_what_it_takes(spark):
    rows = table(spark)
    docs = cases.documents(spark, rows)
    mixed = mixing.mix(docs, blocks=16, shards=8)
    assert mixed.columns == docs.columns
    given = defaultdict(int)
    for r in mixed.collect():
        given[r["doc_id"]] += len(cases.words(r["text"]))
    taken = defaultdict(int)
    for r in mixing.Mixer(docs, blocks=16, shards=8).per_document().collect():
        taken[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in given.items() if v} == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    empty = cases.documents(spark, [])
    assert mixing.Mixer(empty).per_document().count() == 0
    assert mixing.mix(empty).count() == 0
