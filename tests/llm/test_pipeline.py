"""Every stage against brute force on what the one before kept."""

import random

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_groups
from tokenizers import Tokenizer

from sievewright.llm import mixing
from sievewright.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(6)
    rows = [(k, "\n".join(cases.prose(rng, 30) for _ in range(3)), f"s{k % 3}") for k in range(60)]
    body = cases.prose(rng, 80).split()
    for k in range(100, 108):
        copy = list(body)
        copy[k % 80] = f"x{k}"
        rows.append((k, " ".join(copy), "s1"))
    rows += [(200, rows[0][1], "s0"), (201, rows[1][1] + "\nfresh line of its own", "s0"), (202, None, "s0"), (203, "123 456", "s2"), (204, "", None)]
    docs = [cases.documents(spark, rows)]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], "unused").cache())
    return docs


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "tokens"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language(stages):
    assert sorted(pairs(stages[1])) == sorted(p for p in pairs(stages[0]) if p[1] and any(map(str.isalpha, p[1])))


def test_lines(stages):
    left = brute_lines(pairs(stages[1]), 1)
    expected = [(k, left[k, t]) for k, t in pairs(stages[1]) if left[k, t].strip()]
    assert sorted(pairs(stages[2])) == sorted(expected)
    assert 200 not in dict(expected) and dict(expected)[201] == "fresh line of its own"


def test_near_duplicates(stages):
    groups = brute_groups(pairs(stages[2]))
    assert sorted(k for k, _ in pairs(stages[3])) == sorted(g[0] for g in groups if g[0] == g[1])
    assert not {101, 102, 103, 104, 105, 106, 107} & set(dict(pairs(stages[3]))) and 100 in dict(pairs(stages[3]))


def test_mix(stages):
    given, taken = {}, {}
    for k, t in pairs(stages[4]):
        given[k] = given.get(k, 0) + len(cases.words(t))
    for r in mixing.Mixer(stages[3]).per_document().collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert given == {k: v for k, v in taken.items() if v}


def test_tokens(stages):
    library = Tokenizer.from_file(vocabulary())
    expected = sorted((k, len(library.encode(t, add_special_tokens=False).ids)) for k, t in pairs(stages[4]))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in stages[5].collect()) == expected


def test_empty_documents(spark):
    docs = cases.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


def test_near_duplicates_go_by_id_and_text(spark):
    """One id with a near copy of a smaller id and clean texts of its own loses the copy only."""
    rng = random.Random(9)
    body = cases.prose(rng, 80).split()
    copy = " ".join([*body[:-1], "changed"])
    clean = [cases.prose(rng, 40) for _ in range(3)]
    rows = [(1, " ".join(body)), (7, copy), (7, copy), *[(7, t) for t in clean], (7, None), (None, copy)]
    left = corpus_pipeline.one_of_each_group(spark, cases.documents(spark, rows), "unused")
    assert sorted(pairs(left), key=repr) == sorted([rows[0], *rows[3:]], key=repr)


def test_language_without_labels_keeps_letters(spark):
    docs = cases.documents(spark, cases.awkward())
    for table in (docs.withColumn("lang", F.lit(None).cast("string")), docs):
        left = corpus_pipeline.known_language(spark, table, "unused")
        assert left.columns == docs.columns
        assert sorted(pairs(left), key=repr) == sorted((r[:2] for r in cases.awkward() if r[1] and any(map(str.isalpha, r[1]))), key=repr)
