"""Toxic spans by a linear-chain conditional random field, and document scores made of its marginals.

Tokens are runs of letters, digits and bytes beyond ASCII, in lower case; their features are the word itself and its
first three to eight and last three to five bytes, hashed. The field has the tags clean and toxic.

Labels are those of documents, so tokens are labelled first: a token is toxic if it stands in a toxic document and has a
feature that the toxic documents of the sample show far more often than the clean ones (log-likelihood ratio above
EVIDENCE), so that at the shares of all labelled rows at least PURITY of the documents that have it are toxic, and no token of the document has
much stronger evidence (RIVAL); what only keeps company with toxic words is clean. The field is fitted to these labelled tokens by gradients of its
log-likelihood, from forward-backward. Forward-backward over whole texts then gives every token's probability of being toxic
and the probability that no token of the text is; the document score is a logistic function of the latter and of the largest
token's probability, fitted on the same sample and moved to the share of toxic documents among all labelled rows. Offending offsets are runs of tokens whose probability is at least SPAN.

The sample: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, those whose id and text hash lowest, at most SAMPLE_WINDOWS
windows of WINDOW tokens of each, spread over the whole text. This bound is all that reaches the driver; scoring
reads whole texts. Without toxic or without clean documents in the sample nothing is learned and every score is
the share of toxic documents (0 if there are none).

A text's recursions are cut into chunks whose transfer matrices are combined, so a very long text costs
in proportion to its length. Null and empty texts have the score of a text without tokens. Repeated rows are scored alike; a
document with labels of both kinds counts as toxic; an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.common import mix, row_key, row_sample, slices, stream, text_buffers

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS, WINDOW = 1500, 2500, 4, 64
EVIDENCE, PURITY, RIVAL = 14.0, 0.8, 0.4
BUCKETS = 1 << 19
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4, 5)
FEATURES = 1 + len(PREFIXES) + len(SUFFIXES)
ROUNDS, RATE, SHRINK = 30, 0.7, 1e-4
CHUNK = 256
THRESHOLD, SPAN, FLOOR = 0.3, 0.5, 0.3


# ---- tokens and features ----

def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case; lengths stay."""
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[capital] += 32
    return low


class Tokens(NamedTuple):
    """Byte range, text number and feature buckets of every token, and the first token of every text."""
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    features: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    table = np.zeros(256, bool)
    table[0x80:] = table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    word = table[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], ends[tails] = word[heads], word[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    features = np.zeros((len(start), FEATURES), np.int32)
    if len(start):
        low = _lowered(data)
        names = stream(31, 256)[low]
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        place = (np.arange(len(data)) - np.concatenate(([0], start))[np.cumsum(begins)]) % 64      # the sum tells words apart far beyond 64 bytes
        sums = np.add.reduceat(np.where(word, names * powers[place], np.uint64(0)), start)
        columns = [sums + (end - start).astype(np.uint64)]
        head, tail = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        last = len(data) - 1
        for k in range(max(PREFIXES)):
            inside = start + k < end
            head = head + np.where(inside, names[np.minimum(start + k, last)] * powers[k], np.uint64(0))
            if k + 1 in PREFIXES:
                columns.append(np.where(inside, head + np.uint64(k + 1), sums))
        for k in range(max(SUFFIXES)):
            inside = end - 1 - k >= start
            tail = tail + np.where(inside, names[np.maximum(end - 1 - k, 0)] * powers[k], np.uint64(0))
            if k + 1 in SUFFIXES:
                columns.append(np.where(inside, tail + np.uint64(100 + k), sums))
        salt = stream(37, FEATURES)
        for j, column in enumerate(columns):
            features[:, j] = (mix(column ^ salt[j]) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return Tokens(start, end, doc, first, features)


# ---- the field ----

class Field(NamedTuple):
    """Weights: by bucket the log-odds of toxic over clean, the transitions (2 x 2, from row to column), the first tag's log-odds, and those of documents."""
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    opening: float
    document: np.ndarray | None
    share: float


def emissions(field: Field, features: np.ndarray) -> np.ndarray:
    return field.weights[features].sum(axis=1, dtype=np.float64) + field.bias


def _potentials(unary: np.ndarray, opens: np.ndarray, transitions: np.ndarray, opening: float) -> list[np.ndarray]:
    """Transfer matrices of all tokens as four arrays, scaled; that of a text's first token forgets what came before."""
    lift = np.clip(unary, -60, 60)
    clean, toxic = np.exp(-np.maximum(0, lift)), np.exp(np.minimum(0, lift))
    e = np.exp(np.clip(transitions, -30, 30))
    m = [clean * e[0, 0], toxic * e[0, 1], clean * e[1, 0], toxic * e[1, 1]]
    for k in (0, 2):
        m[k][opens], m[k + 1][opens] = clean[opens], toxic[opens] * np.exp(np.clip(opening, -30, 30))
    return m


def _carried(m: list[np.ndarray], odds: float) -> np.ndarray:
    """Odds of toxic over clean of a row vector carried through the matrices, after each of them; exact at any length.

    The sequence is cut into chunks. The product of each is formed side by side, chunk borders are
    resolved by the same function, and the chunks are then run side by side from their borders.
    """
    n = len(m[0])
    if n <= CHUNK:
        out = np.empty(n)
        for t, (a, b, c, d) in enumerate(zip(*m)):
            odds = out[t] = (b + odds * d) / (a + odds * c)
        return out
    chunks = -(-n // CHUNK)
    side = []
    for k, v in enumerate(m):
        padded = np.full(chunks * CHUNK, 1.0 if k in (0, 3) else 0.0)
        padded[:n] = v
        side.append(np.ascontiguousarray(padded.reshape(chunks, CHUNK).T))
    p, q, r, s = (v[0] for v in side)
    for t in range(1, CHUNK):
        a, b, c, d = (v[t] for v in side)
        p, q, r, s = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    ratio = np.concatenate(([odds], _carried([p, q, r, s], odds)[:-1]))
    out = np.empty((CHUNK, chunks))
    for t in range(CHUNK):
        ratio = out[t] = (side[1][t] + ratio * side[3][t]) / (side[0][t] + ratio * side[2][t])
    return out.T.reshape(-1)[:n]


def _opens(first: np.ndarray) -> np.ndarray:
    return first[:-1][first[:-1] < first[1:]]


def marginals(unary: np.ndarray, first: np.ndarray, transitions: np.ndarray, opening: float):
    """Probability of toxic of every token, probability of clean given that all before are, and the expected tag pairs (2 x 2)."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros((2, 2))
    opens = _opens(first)
    m = _potentials(unary, opens, transitions, opening)
    forward = np.clip(_carried(m, 1.0), 1e-30, 1e30)
    # backward odds: the column vector m[t + 1] @ beta[t + 1]; flat after a text's last token, since the next text forgets
    backward = np.ones(n)
    if n > 1:
        a, b, c, d = (v[:0:-1] for v in m)
        backward[:-1] = _carried([a, c, b, d], 1.0)[::-1]
    backward = np.clip(backward, 1e-30, 1e30)
    odds = forward * backward
    toxic = odds / (1 + odds)
    stay_clean = m[0] / (m[0] + m[1] * backward)
    before = np.concatenate(([1.0], forward[:-1]))
    pairs = [m[0], m[1] * backward, before * m[2], before * m[3] * backward]
    whole = sum(pairs)
    whole[opens] = np.inf
    return toxic, stay_clean, np.array([(v / whole).sum() for v in pairs]).reshape(2, 2)


def document_features(toxic: np.ndarray, stay_clean: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: a constant, the log-odds of any toxic token, and those of the likeliest one.

    Tokens below FLOOR do not add up, so that length alone makes no text toxic.
    """
    count = len(first) - 1
    full = np.flatnonzero(first[:-1] < first[1:])
    out = np.full((count, 3), -12.0)
    out[:, 0] = 1
    if len(full):
        heads = first[:-1][full]
        counts = toxic >= FLOOR
        none = np.add.reduceat(np.where(counts, np.log(np.maximum(stay_clean, 1e-30)), 0.0), heads)
        any_odds = np.log(np.maximum(-np.expm1(np.minimum(none, -1e-12)), 1e-12)) - np.maximum(none, -12)
        top = np.clip(np.maximum.reduceat(toxic, heads), 1e-6, 1 - 1e-6)
        out[full, 1] = np.clip(any_odds, -12, 12)
        out[full, 2] = np.log(top / (1 - top))
    return out


def scores(field: Field, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Document scores and token probabilities."""
    if field.document is None:
        return np.full(len(found.first) - 1, field.share), np.zeros(len(found.start))
    toxic, stay, _ = marginals(emissions(field, found.features), found.first, field.transitions, field.opening)
    x = document_features(toxic, stay, found.first) @ field.document
    return 1 / (1 + np.exp(-np.clip(x, -40, 40))), toxic


# ---- training ----

def label_tokens(found: Tokens, toxic_doc: np.ndarray, share: float) -> np.ndarray:
    """Which tokens of toxic documents have a feature that tells toxic documents from clean ones."""
    n = np.array([(~toxic_doc).sum(), toxic_doc.sum()], float)
    evidence = np.zeros(len(found.start))
    for column in found.features.T:         # one kind of feature at a time: a document counts once a bucket
        pairs = np.unique(found.doc * BUCKETS + column)
        hit = toxic_doc[pairs // BUCKETS]
        with_toxic = np.bincount(pairs[hit] % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(with_toxic)
        a, b = with_toxic[used].astype(float), np.bincount(pairs[~hit] % BUCKETS, minlength=BUCKETS)[used].astype(float)
        expected = (a + b) * n[1] / n.sum()
        ratio = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(np.maximum(b, 1) / np.maximum(a + b - expected, 1e-9)), 0))
        odds = (a / n[1]) / ((b + 0.5) / n[0]) * share / (1 - share)
        telling = np.zeros(BUCKETS)
        telling[used] = np.where((ratio > EVIDENCE) & (odds > PURITY / (1 - PURITY)), ratio, 0)
        np.maximum(evidence, telling[column], out=evidence)
    evidence *= toxic_doc[found.doc]
    strongest = np.zeros(len(found.first) - 1)
    full = np.flatnonzero(found.first[:-1] < found.first[1:])
    strongest[full] = np.maximum.reduceat(evidence, found.first[:-1][full])
    return (evidence > 0) & (evidence >= RIVAL * strongest[found.doc])


def gradients(unary, first, transitions, opening, tags):
    """Gradients of the log-likelihood of the tags: by token, by transition, by opening."""
    toxic, _, pairs = marginals(unary, first, transitions, opening)
    by_token, opens = tags - toxic, _opens(first)
    inner = np.ones(len(tags), bool)
    inner[opens] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(tags[at - 1].astype(int) * 2 + tags[at].astype(int), minlength=4).reshape(2, 2)
    return by_token, seen - pairs, by_token[opens].sum()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a ridge: Newton steps, halved while they do not raise the penalised likelihood."""
    def value(w):
        z = x @ w
        return float((y * z - np.logaddexp(0, z)).sum() - ridge / 2 * w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while value(w + step) < value(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(data: np.ndarray, offsets: np.ndarray, toxic_doc: np.ndarray, share: float | None = None) -> Field:
    """The field and the document weights of labelled texts; `share` is that of toxic documents where the texts were drawn, if theirs is another."""
    drawn = float(toxic_doc.mean()) if len(toxic_doc) else 0.0
    share = drawn if share is None else share
    nothing = Field(np.zeros(1), 0.0, np.zeros((2, 2)), 0.0, None, share)
    found = tokens(data, offsets)
    if not len(found.start) or toxic_doc.all() or not toxic_doc.any():
        return nothing
    tags = label_tokens(found, toxic_doc, share).astype(float)
    _, heads, which = np.unique(found.features.astype(np.uint64) @ (stream(41, FEATURES) | np.uint64(1)), return_index=True, return_inverse=True)
    words, which, n = found.features[heads], which.ravel(), len(tags)
    weights, bias, transitions, opening = np.zeros(BUCKETS), -6.0, np.zeros((2, 2)), 0.0
    squares, others = np.full(BUCKETS, 1e-8), np.full(6, 1e-8)
    flat = words.ravel()
    for _ in range(ROUNDS):
        unary = (weights[words].sum(axis=1) + bias)[which]
        token, pair, opens = gradients(unary, found.first, transitions, opening, tags)
        by_word = np.bincount(which, weights=token, minlength=len(words))
        slope = np.bincount(flat, weights=np.repeat(by_word, FEATURES), minlength=BUCKETS) / n ** 0.5 - SHRINK * weights
        squares += slope * slope
        weights += RATE * slope / np.sqrt(squares)
        rest = np.append(pair.ravel(), (token.sum(), opens)) / n ** 0.5 - SHRINK * np.append(transitions.ravel(), (bias, opening))
        others += rest * rest
        step = RATE * rest / np.sqrt(others)
        transitions, bias, opening = transitions + step[:4].reshape(2, 2), bias + step[4], opening + step[5]
    toxic, stay, _ = marginals((weights[words].sum(axis=1) + bias)[which], found.first, transitions, opening)
    x, y = document_features(toxic, stay, found.first), toxic_doc.astype(float)
    told = ~toxic_doc       # toxic documents whose windows show no toxic token say nothing about the score of those that do
    told[found.doc[tags > 0]] = True
    document = logistic(x[told], y[told])
    document[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Field(weights.astype(np.float32), bias, transitions, opening, document, share)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Field:
    """Fit on the labelled rows of `docs`; see the module for the bounds of the sample."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    known = named.select("id", row_key("toxicity").alias("__key")).join(marked, F.col("id") == F.col("__id")).select(
        "__key", F.when(F.col("label") == 1, 1).otherwise(0).alias("label"))

    def cut(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            found = tokens(data, offsets)
            pieces, label = [], batch.column("label").to_pylist()
            for a, b, stop in zip(found.first[:-1], found.first[1:], offsets[1:]):
                heads = range(a, b, WINDOW)
                chosen = np.unique(np.linspace(0, len(heads) - 1, SAMPLE_WINDOWS).astype(int)) if b > a else ()
                pieces.append(b"\n".join(data[found.start[heads[k]]:found.end[min(heads[k] + WINDOW, b) - 1]].tobytes() for k in chosen))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pieces, pa.binary())], names=["label", "piece"])

    rows = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = rows.get(1, 0) / max(1, sum(rows.values()))
    found = [row_sample(named, most, "toxicity", among=known.where(F.col("label") == k)).select(F.lit(k).alias("label"), "text")
             for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = found[0].unionByName(found[1]).mapInArrow(cut, "label int, piece binary").toPandas()
    sample = sample.sort_values(["label", "piece"], kind="stable")
    pieces = list(sample["piece"])
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
    return fit(np.frombuffer(b"".join(pieces), np.uint8), offsets, sample["label"].to_numpy(dtype=bool), share)


# ---- scoring ----

def score_texts(docs: DataFrame, field: Field, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """(keep..., score, predicted), one row a document."""
    narrow = docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches, text):
            score, _ = scores(shared.value, tokens(*text_buffers(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])
    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keep)
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")


def toxic_spans(docs: DataFrame, field: Field, text: str = "text", id_col: str = "doc_id", least: float = SPAN) -> DataFrame:
    """(id_col, start, end, piece, score) of every run of toxic tokens; offsets are code points, end exclusive, the score is the run's largest probability."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            found = tokens(data, offsets)
            _, toxic = scores(shared.value, found)
            hit = np.flatnonzero(toxic >= least)
            if not len(hit):
                continue
            point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(found.doc[hit]) != 0)))
            heads = np.flatnonzero(new)
            lo, hi = hit[heads], hit[np.append(heads[1:], len(hit)) - 1]
            doc, a, b = found.doc[lo], found.start[lo], found.end[hi]
            base = point[offsets[doc]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), pa.array(point[a] - base), pa.array(point[b] - base),
                 pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a, b)]), pa.array(np.maximum.reduceat(toxic[hit], heads))],
                names=[id_col, "start", "end", "piece", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, start long, end long, piece string, score double")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; documents of remainder 2 are held out. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4
