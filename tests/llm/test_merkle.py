import hashlib
import random
import zlib
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][i:i + 3])) for i in range(0, len(found[-1]), 3)])
    return found


def climb(tree, at, node):
    siblings = ""
    for level in tree[:-1]:
        run = level[at - at % 3:at - at % 3 + 3]
        siblings += "".join(d for k, d in enumerate(run) if k != at % 3)
        run[at % 3] = node
        node, at = digest("".join(run)), at // 3
    return siblings, node


def brute(docs):
    """Rows of the contract, by walking plain lists."""
    by_source = defaultdict(list)
    for r in docs:
        values = [r[c] for c in merkle.FIELDS]
        text = r["text"]
        even = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
        new = encoded(*values[:-1], text.replace("\n", "")) if even and text is not None else None
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, encoded(*values), new, r["doc_id"]))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by_source[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, new, number) in enumerate(by_source[s]):
            low, subroot = climb(trees[s], at, leaf)
            high, root = climb(top, k, subroot)
            folded = climb(top, k, climb(trees[s], at, new or leaf)[1])[1]
            out.append((number, leaf, subroot, root, digest(low + high), folded, folded == root))
    return out


def rows_of(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_against_plain_lists(spark, height):
    rng = random.Random(3)
    rows = [(k, f"line {k}\nnext {rng.random()}" if k % 3 else f"one line {k}", "hot" if k % 3 else f"s{k % 7}") for k in range(260)]
    rows += [(k, t, "s") for k, t in cases.awkward()] + [(900, "alone\n", "\U0001F600"), (901, "null source\n", None), (902, "x\ny", None), (903, "é\n", "é")]
    docs = cases.documents(spark, rows)
    assert rows_of(merkle.proofs(docs, height=height)) == sorted(brute(docs.collect()), key=repr)


def test_versions_share_what_they_do_not_copy():
    nodes = [digest(str(k)) for k in range(40)]
    block = merkle.Block(list(nodes), merkle.height_of(40))
    before = [list(level) for level in block.levels]
    copies = block.changed(17, digest("new"))
    assert block.levels == before and len(copies) == 5
    changed = list(nodes)
    changed[17] = digest("new")
    assert copies[-1] == levels(changed)[-1][0] == merkle.follow(digest("new"), block.path(17))


def test_own_tampering(spark):
    """Any change of the text is found, and only where it is."""
    docs = cases.documents(spark, [(k, f"text {k}", f"s{k % 2}") for k in range(50)])
    found = merkle.proofs(docs, lambda d: F.when(F.col("doc_id").isin(7, 20), F.concat("text", F.lit("!")))).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {7, 20}
    assert all((r["copied"] > 0) == (r["doc_id"] in (7, 20)) for r in found)


def test_small_tables(spark):
    assert merkle.proofs(cases.documents(spark, [])).count() == 0
    one = merkle.proofs(cases.documents(spark, [(1, "x")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == digest("") and one["verified"]
