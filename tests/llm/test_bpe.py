import hashlib
import random
import time

import cases
import numpy as np
import pytest
from tokenizers import Tokenizer

from sievewright.llm import bpe
from sievewright.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_ids_equal_the_librarys(library):
    rng = random.Random(5)
    alphabet = "aaabcdeAB 'stremvld09  \t\n\x0b\x0c\r\x1c\x1f\x85\xa0éÉßΣσςİı½²Ⅷ文字。\U0001F600‍́_-.,<|> 　ﬁǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|startoftext|>Hi<|endoftext|><|endoftext|> x<|STARTOFTEXT|>", "a" * 301, "banana " * 50, ""]
    mine = bpe.WordBpe(vocabulary())
    ids, first = mine.encode(texts)
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        part = ids[first[k]:first[k + 1]]
        assert part.tolist() == found.ids, texts[k]
        assert mine.decode(part) == library.decode(found.ids, skip_special_tokens=False)


def test_cache_may_start_afresh(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    mine = bpe.WordBpe(vocabulary())
    for text in ("one two three four", "five six one two", "one <|endoftext|>"):
        assert mine.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library):
    rows = cases.awkward()
    found = bpe.round_trip_digests(cases.documents(spark, rows), vocabulary()).collect()
    assert len(found) == len(rows)
    expected = []
    for number, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((number, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_encode_then_decode(spark, library):
    docs = cases.documents(spark, cases.awkward())
    found = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()
    by_id = {r["doc_id"]: r["decoded"] for r in found}
    text = dict(cases.awkward())[9]
    assert by_id[9] == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert by_id[1] == ""


def test_empty_table(spark):
    assert bpe.round_trip_digests(cases.documents(spark, []), vocabulary()).count() == 0


@pytest.mark.parametrize("most", [1, 5, bpe.LONG_WORD])
def test_queue_of_pairs_equals_the_library(library, monkeypatch, most):
    """Long words take another path than short ones; the ids are those of the library, beside short words and special tokens."""
    monkeypatch.setattr(bpe, "LONG_WORD", most)
    rng = random.Random(11)
    texts = ["".join(rng.choice("aabcdestrem éß文") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a" * 3001, "ab" * 2000, "".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "<|endoftext|> word " + "x" * 700]
    mine = bpe.WordBpe(vocabulary())
    ids, first = mine.encode(texts)
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k]:first[k + 1]].tolist() == found.ids, texts[k][:80]


def test_a_word_of_a_million_letters(library):
    rng = random.Random(12)
    text = "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=1_000_000))
    start = time.time()
    ids, _ = bpe.WordBpe(vocabulary()).encode([text])
    assert time.time() - start < 60
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_replaces_a_column_of_its_name(spark, library):
    docs = cases.documents(spark, [(1, "some words"), (2, None)])
    tokens = bpe.encode(docs, vocabulary()).selectExpr("doc_id", "'old' AS decoded", "ids")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(tokens, vocabulary()).collect()}
    assert found == {1: library.decode(library.encode("some words", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}
    again = bpe.decode(tokens.drop("decoded"), vocabulary(), out="ids")
    assert again.columns == ["doc_id", "ids"]
