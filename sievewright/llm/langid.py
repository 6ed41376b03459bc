"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of 256 bytes (with a few bytes of look-ahead, zeros
past its end). Bytes are embedded, filters of three widths slide over the window,
the largest response of each filter is kept, and a softmax over the known
languages follows. A text's probability is the mean over all its windows, so
whole texts count.

Training: at most SAMPLE_PER_LANG documents a language and SAMPLE_TOTAL in all (first one
of every language, then a second one), those whose id and text hash lowest, at most SAMPLE_WINDOWS windows of each, spread over
the whole text. This bounded sample is all that reaches the driver. Repeated ids are as many documents as they have texts,
repeated rows count once in it. A text with labels of several languages may stand for each.
Without labelled documents nothing is learned and every text is `und`.
Null texts and texts without a letter are `und` with score 0; very long texts are read whole, window by window; repeated rows
are scored alike; an empty table gives no rows. Ties go to the
language that sorts first. Further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.common import row_sample, slices, text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
AHEAD = max(WIDTHS)         # zero bytes that end every text
SAMPLE_PER_LANG, SAMPLE_TOTAL, SAMPLE_WINDOWS = 400, 4000, 8
STEPS, BATCH, RATE = 500, 64, 4e-3
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts laid out in whole windows: padded bytes, and the first window of each text (one more entry)."""
    length = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum((length + AHEAD + WINDOW - 1) // WINDOW)))
    padded = np.zeros(first[-1] * WINDOW + AHEAD, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], length)] = data
    return padded, first


class ByteNet:
    """Weights of the network; `fit` trains them, `probabilities` applies them."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        rng = np.random.default_rng(7)
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBED)),
                        **{f"conv{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS},
                        "bias": np.zeros(FILTERS * len(WIDTHS)),
                        "dense": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))),
                        "shift": np.zeros(len(languages))}

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(x)
        embedded = w["embed"][x]
        at, pooled = {}, []
        for width in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)[:, :WINDOW]
            patches = patches.transpose(0, 1, 3, 2).reshape(n, WINDOW, width * EMBED)
            response = patches @ w[f"conv{width}"]
            at[width] = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, at[width][:, None], axis=1)[:, 0])
        before = np.concatenate(pooled, axis=1) + w["bias"]
        hidden = np.tanh(before)
        logits = hidden @ w["dense"] + w["shift"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ w["dense"].T) * (1 - hidden ** 2)
        grad = {"dense": hidden.T @ p, "shift": p.sum(axis=0), "bias": back.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        for k, width in enumerate(WIDTHS):
            d = back[:, k * FILTERS:(k + 1) * FILTERS]
            places = at[width][:, :, None] + np.arange(width)
            patch = embedded[np.arange(n)[:, None, None], places].reshape(n, FILTERS, width * EMBED)
            grad[f"conv{width}"] = np.einsum("nf,nfk->kf", d, patch)
            into = (d[:, :, None] * w[f"conv{width}"].T).reshape(n, FILTERS, width, EMBED)
            np.add.at(grad["embed"], x[np.arange(n)[:, None, None], places], into)
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray) -> "ByteNet":
        """Adam on batches that hold every language equally often."""
        rng = np.random.default_rng(13)
        pools = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(p, max(1, BATCH // len(pools))) for p in pools])
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, g in self._gradients(x[rows], y[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.weights[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def tables(self):
        """Responses by byte pair: a filter is a sum of two table rows instead of a product."""
        w = self.weights
        part = {width: [(w["embed"] @ w[f"conv{width}"][k * EMBED:(k + 1) * EMBED]).astype(np.float32)
                        for k in range(width)] for width in WIDTHS}
        pair = {width: (part[width][0][:, None] + part[width][1][None]).reshape(65536, FILTERS) for width in WIDTHS}
        four = (part[4][2][:, None] + part[4][3][None]).reshape(65536, FILTERS)
        return np.concatenate([pair[width] for width in WIDTHS], axis=1), part[3][2], four

    def probabilities(self, padded: np.ndarray, tables, chunk: int = 32) -> np.ndarray:
        """Language probabilities of every window."""
        heads, three, four = tables
        count = (len(padded) - AHEAD) // WINDOW
        pairs = padded[:-1].astype(np.int32) * 256 + padded[1:]
        pooled = np.zeros((count, FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, count, chunk):
            b = min(count, a + chunk)
            lo, hi = a * WINDOW, b * WINDOW
            response = heads[pairs[lo:hi]]
            response[:, FILTERS:2 * FILTERS] += three[padded[lo + 2:hi + 2]]
            response[:, 2 * FILTERS:] += four[pairs[lo + 2:hi + 2]]
            response = response.reshape(b - a, WINDOW, -1)
            while response.shape[1] > 1:
                half = response.shape[1] // 2
                response = np.maximum(response[:, :half], response[:, half:])
            pooled[a:b] = response[:, 0]
        logits = np.tanh(pooled + self.weights["bias"]) @ self.weights["dense"] + self.weights["shift"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def training_windows(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The bounded sample: languages, windows, labels. `labelled` has id, text, lang."""
    def cut(batches):
        for batch in slices(batches):
            padded, first = windows(*text_buffers(batch.column("text")))
            lang, found, key = batch.column("lang").to_pylist(), [], []
            for row, (a, b) in enumerate(zip(first[:-1], first[1:])):
                for k in np.unique(np.linspace(a, b - 1, SAMPLE_WINDOWS).astype(int)) if b > a else ():
                    found.append(padded[k * WINDOW:(k + 1) * WINDOW + AHEAD].tobytes())
                    key.append(lang[row])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    chosen = row_sample(labelled, SAMPLE_PER_LANG, "langid", "lang", SAMPLE_TOTAL).select("text", "lang")
    sample = chosen.mapInArrow(cut, "lang string, window binary").toPandas()
    if sample.empty:
        return [], np.zeros((0, WINDOW + AHEAD), np.uint8), np.zeros(0, np.int64)
    sample = sample.sort_values(["lang", "window"], kind="stable")
    languages = sorted(set(sample["lang"]))
    x = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW + AHEAD)
    return languages, x, np.array([languages.index(v) for v in sample["lang"]])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> ByteNet:
    """Fit the network on rows with a language; see the module for the bound of the sample."""
    languages, x, y = training_windows(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")))
    net = ByteNet(languages)
    return net.fit(x, y) if len(languages) > 1 else net


def lettered(texts: list) -> np.ndarray:
    """Which texts are not null and have a letter."""
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a letter; needs no network."""
    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(lettered(batch.column(text).to_pylist()), pa.bool_()))
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def _scores(net: ByteNet, tables, column) -> tuple[list[str], np.ndarray]:
    texts = column.to_pylist()
    data, offsets = text_buffers(column)
    padded, first = windows(data, offsets)
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = net.probabilities(padded, tables)
    weight = np.minimum(WINDOW, np.repeat(np.diff(offsets), np.diff(first))
                        - WINDOW * (np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)))).clip(0)
    sums = np.add.reduceat(p * weight[:, None], first[:-1], axis=0)
    mean = sums / np.maximum(1, np.diff(offsets))[:, None]
    best = mean.argmax(axis=1)
    named = lettered(texts)
    score = np.where(named, mean[np.arange(len(texts)), best].clip(0, 1), 0.0)
    return [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, named)], score


def predict(docs: DataFrame, net: ByteNet, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of `docs` but those named lang_out and score_out, then the predicted language and its probability."""
    kept = docs.drop(lang_out, score_out)

    def run(batches):
        tables = net.tables()
        for batch in slices(batches, text):
            lang, score = _scores(net, tables, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, lang_out, score_out])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{lang_out}` string, `{score_out}` double")


def narrow_predict(docs: DataFrame, net: ByteNet, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Like `predict`, but the text does not come back from the workers."""
    def run(batches):
        tables = net.tables()
        for batch in slices(batches, text):
            lang, score = _scores(net, tables, batch.column(text))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*keep, "lang_pred", "score"])
    narrow = docs.select(*keep, text)
    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keep)
    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; documents of remainder 1 are held out. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3
