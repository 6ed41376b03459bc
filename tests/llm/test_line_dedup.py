import random

import cases
import pytest
from pyspark.sql import functions as F

from sievewright.llm import line_dedup


def brute(rows, m):
    """Text left of every document; the same (id, text) is one document."""
    filled = {}
    for number, text in set(rows):
        filled[number, text] = [(k, line) for k, line in enumerate((text or "").split("\n")) if cases.words(line)]
    seen, gone = set(), {key: set() for key in filled}
    for key in sorted(filled, key=lambda k: (k[0] is not None, k[0] or 0)):
        lines = [line for _, line in filled[key]]
        for i in range(len(lines) - m + 1):
            run = tuple(lines[i:i + m])
            if run in seen:
                gone[key].update(range(i, i + m))
            seen.add(run)
    out = {}
    for key, lines in filled.items():
        drop = {lines[o][0] for o in gone[key]}
        text = key[1]
        out[key] = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
    return out


@pytest.mark.parametrize("m", [1, 2, 4])
def test_against_brute_force(spark, m):
    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice(["a b", "c", "", "d e f", f"u{k}", "  "]) for _ in range(rng.randrange(0, 14)))) for k in range(100, 220)]
    rows += cases.awkward() + [(600, "same\nline\nagain"), (600, "same\nline\nagain")]
    docs = cases.documents(spark, rows).withColumn("removed", F.lit(1)).withColumn("pos", F.lit(2))
    found = line_dedup.dedup_lines(docs, m)
    assert [c for c in found.columns if c[:2] != "__"] and set(docs.columns) <= set(found.columns)
    expected = brute(rows, m)
    left = sorted(repr((r["doc_id"], r["text"])) for r in found.select("doc_id", "text").collect())
    assert left == sorted(repr((k, expected[k, t])) for k, t in rows)


def test_runs_and_depth(spark):
    block = "\n".join(f"line {k}" for k in range(9))
    docs = cases.documents(spark, [(1, block), (2, "new\n" + block + "\nmid\nline 3"), (3, "alone")])
    found = {r["doc_id"]: tuple(r)[1:-1] for r in line_dedup.line_report(docs).collect()}
    assert found == {1: (9, 0, 0, 0, 0), 2: (12, 10, 2, 9, 8), 3: (1, 0, 0, 0, 0)}


def test_ranks_follow_the_order(spark):
    docs = cases.documents(spark, [(k, "\n".join(["head", f"b{k % 3}", f"c{k % 2}", "tail"])) for k in range(12)])
    for depth, suffixes in line_dedup.levels(docs):
        sizes = {r["rank"]: r["count"] for r in suffixes.groupBy("rank").count().collect()}
        spans = sorted((rank, rank + n) for rank, n in sizes.items())
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), depth      # intervals of one depth do not overlap


def test_only_powers_of_two(spark):
    with pytest.raises(ValueError):
        line_dedup.copied_lines(cases.documents(spark, [(1, "a")]), 3)


def test_empty_table(spark):
    assert line_dedup.line_report(cases.documents(spark, [])).count() == 0
