import hashlib
from collections import defaultdict

import cases
import pytest

from sievewright.llm import exact

TABLE = str.maketrans(exact.UPPER, exact.LOWER)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    rows = cases.awkward() + [(k, f"Copy {k % 3}") for k in range(100, 400)] + [(500, "ÄB"), (501, "äb"), (502, "Äb")]
    groups = defaultdict(list)
    for number, text in rows:
        groups[(text or "").translate(TABLE)].append(number)
    expected = []
    for number, text in rows:
        normal = (text or "").translate(TABLE)
        known = [x for x in groups[normal] if x is not None]
        stays = (max(known) if keep == "largest" else min(known)) if known else None
        expected.append((number, stays, len(groups[normal]), number == stays, hashlib.sha256(normal.encode()).hexdigest()))
    found = exact.exact_groups(cases.documents(spark, rows), keep=keep).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_dedup_keeps_whole_rows(spark):
    docs = cases.documents(spark, [(1, "A"), (2, "a"), (3, "b")])
    left = exact.dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_dedup_keeps_other_texts_of_an_id(spark):
    docs = cases.documents(spark, [(1, "A"), (2, "a"), (1, "clean"), (None, "a"), (None, "other"), (1, None)])
    left = sorted(((r["doc_id"], r["text"]) for r in exact.dedup(docs).collect()), key=repr)
    assert left == sorted([(2, "a"), (1, "clean"), (None, "other"), (1, None)], key=repr)


def test_empty_table(spark):
    assert exact.exact_groups(cases.documents(spark, [])).count() == 0
