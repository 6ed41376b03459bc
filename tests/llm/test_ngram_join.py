import random
from collections import defaultdict
from itertools import combinations

import cases
import pyarrow as pa
from pyspark.sql import functions as F

from sievewright.llm import links, ngram_join


def gram_set(text):
    w = cases.words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = defaultdict(list)
    for number, text in rows:
        if gram_set(text) and number is not None:
            sets[gram_set(text)].append(number)
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s
    count = defaultdict(int)
    for a, b in combinations(sets, 2):
        common = len(a & b)
        if 5 * common >= 4 * (len(a) + len(b) - common):
            count[a] += 1
            count[b] += 1
            if root(a) is not root(b):
                parent[root(a)] = root(b)
    first = defaultdict(list)
    for s, ids in sets.items():
        first[root(s)] += ids
    out = []
    for number, text in rows:
        s = gram_set(text)
        if not s or number is None:
            out.append((number, number, number, 1, 0))
        else:
            out.append((number, min(first[root(s)]), min(sets[s]), len(sets[s]), count[s]))
    return out


def planted(seed=8):
    rng = random.Random(seed)
    rows = [(k, cases.prose(rng, rng.randrange(1, 90))) for k in range(1000, 1100)]
    base = cases.prose(rng, 120).split()
    for k in range(2000, 2300):     # one large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(copy)))
    passage = cases.prose(rng, 20)      # shared by many that are not alike
    rows += [(k, passage + " " + cases.prose(rng, 60)) for k in range(3000, 3100)]
    for k in range(4000, 4040):         # pairs around the threshold
        a = cases.prose(rng, 100).split()
        b = list(a)
        for _ in range(k % 7):
            b[rng.randrange(100)] = "changed"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 100)      # several blocks in the large group
    rows = planted() + cases.awkward()
    found = ngram_join.jaccard_groups(cases.documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_rows_grow_with_the_group_not_its_square(spark):
    rows = planted()
    _, counts, edges = ngram_join.links(cases.documents(spark, rows))
    assert counts.agg(F.sum("n_links")).first()[0] > 10_000
    assert edges.count() < 40 * len(rows)


def test_pruning_bounds():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == list(range(16, 129, 16)) and all(0 < least[n] < 0.8 * n for n in least)
    assert ngram_join.least_matches(0.8, 1e-2)[128] > least[128]


def test_units_are_never_torn():
    table = pa.table({"band": [0, 0, 0, 1, 1], "key": [5, 5, 7, 7, 7]})
    batches = table.to_batches(max_chunksize=2)
    found = [t.to_pydict() for t in ngram_join._units(batches, ["band", "key"])]
    keys = [set(zip(t["band"], t["key"])) for t in found]
    assert sum(len(t["key"]) for t in found) == 5
    assert all(not a & b for a, b in combinations(keys, 2))


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (103, 100)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 104)}, **{k: 200 for k in range(200, 260)}}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert ngram_join.jaccard_groups(cases.documents(spark, [])).count() == 0
