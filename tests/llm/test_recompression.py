import hashlib
import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import recompression
from sievewright.llm.common import Words, text_buffers


def brute(rows, window=20):
    seen, out = set(), {}
    for number, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = cases.words(text)
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                keep[i:i + window] = [False] * window
            seen.add(run)
        left = [w for w, k in zip(words, keep) if k]
        out[number, text] = (number, len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return [out[r] for r in rows]


def planted(seed):
    rng = random.Random(seed)
    passages = [cases.prose(rng, rng.randrange(18, 90)) for _ in range(6)]
    rows = []
    for k in range(300):
        parts = [cases.prose(rng, rng.randrange(0, 40)), rng.choice(passages), cases.prose(rng, rng.randrange(0, 40)), rng.choice(passages)]
        if k % 3 == 0:
            parts.append(" ".join(["x"] * rng.randrange(5, 50)))
        if k % 5 == 0:
            parts.append(" ".join(["p", "q"] * rng.randrange(5, 30)))
        if k % 7 == 0:
            parts = [" ".join(rng.choice("ab") for _ in range(60))]
        rows.append((k, " \n".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = planted(seed) + [(1000 + (k or 0) if k is not None else None, t) for k, t in cases.awkward()]
    found = recompression.dedup_substrings(cases.documents(spark, rows))
    assert sorted(repr(tuple(r)[:4]) for r in found.collect()) == sorted(map(repr, brute(rows)))


def test_unique_ids_take_the_short_way(spark):
    rows = planted(3)
    found = recompression.dedup_substrings(cases.documents(spark, rows), texts=False)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_equal_windows_have_equal_representatives():
    rng = random.Random(7)
    texts = [t for _, t in planted(4)] + [" ".join(rng.choice("aab") for _ in range(80)) for _ in range(60)]
    words = Words(*text_buffers(pa.array(texts)))
    start, name, place = recompression.representatives(words)
    flat = [w for t in texts for w in t.split()]
    known = {}
    for s, n, p in zip(start.tolist(), name.tolist(), place.tolist()):
        assert s <= p < s + 20
        assert known.setdefault(tuple(flat[s:s + 20]), (n, p - s)) == (n, p - s)
    assert len(np.unique(place)) < 0.6 * len(start)


def test_empty_table(spark):
    assert recompression.dedup_substrings(cases.documents(spark, [])).count() == 0
