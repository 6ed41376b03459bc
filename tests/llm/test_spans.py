"""Secrets and personal data."""

import hashlib
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import pii, queries, secrets
from sievewright.llm.automaton import Automaton, Rule
from sievewright.llm.common import slices

VALUE = "[A-Za-z0-9+/_.=-]"


def either(word):
    return "".join(f"[{c}{c.upper()}]" for c in word)


NAMES = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
SECRET = [("assign", re.compile(f"({NAMES})[\"']?\x20*[:=]\x20*[\"']?({VALUE}+)")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
PERSONAL = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_secrets(text):
    found = []
    for k, (_, pattern) in enumerate(SECRET):
        for m in pattern.finditer(text):
            if (len(m.group(2)) >= 8 if k == 0 else len(m.group()) >= (16 if k == 1 else 32)):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def brute_personal(text):
    found = []
    for k, pattern in enumerate(PERSONAL):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            good = {0: True, 1: k == 1 and all(int(p) <= 255 for p in m.group().split(".")), 3: 9 <= len(digits) <= 15,
                    2: 12 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10 == 0}[k]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def automaton():
    return Automaton([*secrets.BASE_RULES, *secrets.MORE_RULES])


def scanned(texts, automaton, most=50_000):
    found = []
    for batch in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], most=most):
        found += secrets.scan(batch.column(0), automaton)
    return found


def test_automaton_equals_the_patterns(automaton):
    rng = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", "\"", "'", "abc", "deadbeef0123", "AKIA", "AKIAABCDEFGHIJKL", "é",
             "\n", ",", "0123456789abcdef" * 2, "xyz.", "-", "AK", "pass", "to", "ſecret", "_", "abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + [None, "", "token=abcdefgh", "abcdefgh"]
    for text, spans in zip(texts, scanned(texts, automaton)):
        assert [s for s in spans if s[1] < 3] == brute_secrets(text or ""), text


def test_texts_do_not_run_into_each_other(automaton):
    assert scanned(["token=", "abcdefgh", "0" * 20, "0" * 20], automaton) == [[], [], [], []]


def test_added_rules(automaton):
    found = scanned(["x ghp_abcdefghijkl0123 y", "xoxb-123-abcdef ", "-----BEGIN RSA PRIVATE KEY-----"], automaton)
    kinds = [r.kind for r in automaton.rules]
    assert [[kinds[k] for _, k, _ in f] for f in found] == [["hub"], ["chat"], ["pem"]]


def test_minimised_states_differ():
    small = Automaton([Rule("a", "(ab|cb)", "d", 1)])
    assert small.table.shape[0] == 4        # nothing, after a or c, after b, found


def spelled(spans, names):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def test_secret_query(spark):
    rows = cases.awkward() + [(50, "é password = 'abcdefghij' " + "f" * 40), (51, "AKIA" + "B" * 14)]
    found = secrets.digests(secrets.find_secrets(cases.documents(spark, rows)), ["assign", "access", "hex"]).collect()
    names = ["assign", "access", "hex"]
    expected = []
    for number, text in rows:
        spans = brute_secrets(text or "")
        expected.append((number, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(spelled(spans, names).encode()).hexdigest()))
    assert sorted(repr(tuple(r)[:5]) for r in found) == sorted(map(repr, expected))
    assert secrets.find_secrets(cases.documents(spark, [])).count() == 0


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x-y.com", ".", "1", "25", "255", "0255", "4539578763621486", " ", "-", "+", "(", ")", "+1 (377) 555-0271", "é", "\n", "10.0.0.1", "_"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == brute_personal(text), text


def test_address_parts_of_many_zeros():
    """Python reads at most 4,300 digits as a number; a part of more zeros is 0."""
    zeros = "0" * 5000
    assert (0, 1, 5006) in pii.base_spans(f"{zeros}.1.2.3") and (0, 1, 5009) in pii.base_spans(f"{zeros}255.1.2.3")
    assert not [s for s in pii.base_spans(f"1.2.{zeros}256.3") if s[1] == 1]


def test_very_long_digit_runs():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("." + "1" * 50_000 + "@") == []


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(1)
    texts = []
    for k in range(400):
        a, b, c = rng.integers(0, 10, 3)
        spans = [f"n{k}.{a}@mail{b}.example.com", f"10.{a}{b}.{c}.7", f"+1 (37{a}) 555-02{b}{c}", "4539578763621486"]
        texts.append(f"some words here {spans[k % 4]} and more words, the end of it\n" * 2)
    pairs = [w for i, t in enumerate(texts) for w in pii._labelled(t, np.random.default_rng(i))]
    return pii.new_tagger().fit(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))


def test_tagger_finds_base_spans_in_any_window(tagger):
    hits = total = 0
    for shift in range(0, 200, 7):
        text = "word " * shift + "mail k9.4@mail3.example.com now or +1 (377) 555-0271 later " + "word " * 30
        base = {(a, k, b) for a, k, b in pii.base_spans(text)}
        total += len(base)
        hits += len(base & {s[:3] for s in pii.tagged_spans([text], tagger)[0]})
    assert hits >= 0.8 * total


def test_gradients_of_the_tagger():
    tagger = pii.new_tagger()
    tagger.weights = {k: v.astype(float) for k, v in tagger.weights.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0]])

    def loss():
        _, score = tagger.emissions(x)
        move, total = tagger._moves(), 0.0
        for n in range(3):
            ahead = score[0, n]
            path = score[0, n, y[n, 0]]
            for t in range(1, 7):
                v = ahead[:, None] + move
                ahead = score[t, n] + np.log(np.exp(v - v.max(axis=0)).sum(axis=0)) + v.max(axis=0)
                path += move[y[n, t - 1], y[n, t]] + score[t, n, y[n, t]]
            total += np.log(np.exp(ahead - ahead.max()).sum()) + ahead.max() - path
        return total / 3
    grad = tagger._gradients(x, y)
    for name, at in (("out", (3, 2)), ("in_left", (x[0, 1], 5)), ("re_right", (2, 7)), ("move", (1, 2)), ("shift", (4,))):
        keep = tagger.weights[name][at]
        tagger.weights[name][at] = keep + 1e-5
        up = loss()
        tagger.weights[name][at] = keep - 1e-5
        down = loss()
        tagger.weights[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name


def test_personal_query(spark):
    rows = cases.awkward() + [(60, "é mail a.b@c.example.org, 10.0.0.255 and 300.1.1.1"), (61, "card 4539 5787 6362 1486; call +1 (377) 555-0271")] * 2
    docs = cases.documents(spark, rows)
    found = secrets.digests(pii.find_personal_data(docs, pii.train(docs)), pii.KINDS).collect()
    expected = []
    for number, text in rows:
        spans = brute_personal(text or "")
        expected.append((number, *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(spelled(spans, pii.KINDS).encode()).hexdigest()))
    assert sorted(repr(tuple(r)[:6]) for r in found) == sorted(map(repr, expected))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, None).collect()}
    assert clean[60] == "é mail <email>, <ip> and 300.1.1.1" and clean[1] is None


def test_nothing_to_find(spark):
    empty = cases.documents(spark, [])
    assert pii.train(empty) is None and pii.find_personal_data(empty, None).count() == 0
    assert pii.train(cases.documents(spark, [(1, "plain words"), (2, None)])) is None


def test_query_keeps_every_base_span(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_personal_data"](spark, sf).collect():
        base = brute_personal(texts[r["doc_id"]])
        assert set(filter(None, spelled(base, pii.KINDS).split(","))) <= set(filter(None, r["spans"].split(",")))
        assert r["base_sha256"] == hashlib.sha256(spelled(base, pii.KINDS).encode()).hexdigest()
