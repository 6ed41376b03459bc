"""Word BPE: encoding and decoding by batched numpy merge rounds.

Texts are cut into words by the tokenizer's own pattern. The distinct words of a
slice lie in one flat symbol array; every round looks all neighbouring pairs up
by binary search over the sorted pair keys, and each word merges its pair of
lowest rank. A word whose pairs have no rank left is done. A word of more than LONG_WORD bytes
would need as many rounds as it has ranks, each over its whole length; its pairs wait in a queue by rank and place instead.

Null and empty texts have no tokens and decode to the empty text. Very long texts are a
slice of their own; repeated rows are encoded alike; an empty table gives no rows. Further columns are ignored by `encode` and the digests,
and kept by `decode` but for one that has the name of its result. The vocabulary
file is a parameter and has to be readable at the same path on every executor;
nothing is trained.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.common import sha256_hex, slices

LONG_WORD = 512             # bytes beyond which a word is merged by a queue of pairs
CACHE_WORDS = 400_000       # words whose ids a task keeps; beyond, it starts afresh

#: The tokenizer's pattern, with its white space spelled out, and the end-of-word mark.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"

#: The same pattern for lower-case texts below U+0180, where the plain engine does; letters and numbers spelled out.
LOW_LETTERS, LOW_NUMBERS = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9²³¹¼-¾"
LOW_PATTERN = (rf"[{LOW_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{LOW_NUMBERS}]"
               rf"|[^{WHITE}{LOW_LETTERS}{LOW_NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for name, number in [*vocab.items(), *self.special.items()]:
            self.token[number] = name
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + END] for s in symbols])
        pairs = np.array([(vocab[a] * self.size + vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.keys, self.rank, self.made, self.merge = pairs[order, 0], order, pairs[order, 1], None
        self.pattern, self.low = regex.compile(PATTERN), re.compile(LOW_PATTERN)
        self.high = re.compile("[^\x00-\u017f]")
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self._forget()

    def _forget(self):
        self.row: dict[str, int] = {}
        self.flat, self.bounds = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        self.total = 0
        for text, number in self.special.items():
            self.row[f"\n{text}"] = len(self.row)
            self._keep(np.array([number]), np.array([1]))

    def _keep(self, ids, lengths):
        self.flat.append(ids)
        self.bounds.append(self.total + np.cumsum(lengths))
        self.total += int(lengths.sum())

    def words(self, text: str) -> list[str]:
        """Lower-case words; a special token is the word of its text behind a line feed."""
        found, at = [], 0
        for mark in self.split.finditer(text) if "<|" in text else ():
            found += self._plain(text[at:mark.start()])
            found.append(f"\n{mark.group()}")
            at = mark.end()
        return found + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")     # lower case without regard to place
        text = text.lower()
        return (self.pattern if self.high.search(text) else self.low).findall(text)

    def encode_long(self, raw: bytes) -> np.ndarray:
        """Ids of one word, by a queue of its pairs: lowest rank first, then leftmost."""
        if self.merge is None:
            self.merge = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        symbol = self.inner[np.frombuffer(raw, np.uint8)].tolist()
        symbol[-1] = int(self.last[raw[-1]])
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*found, i, key) for i, key in enumerate(a * self.size + b for a, b in zip(symbol, symbol[1:])) if (found := self.merge.get(key))]
        queue = [(rank, i, key, made) for rank, made, i, key in queue]
        heapq.heapify(queue)
        while queue:
            _, i, key, made = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j >= n or symbol[i] * self.size + symbol[j] != key:
                continue        # one of the two has been merged since
            symbol[i], symbol[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    key = symbol[k] * self.size + symbol[after[k]]
                    if found := self.merge.get(key):
                        heapq.heappush(queue, (found[0], k, key, found[1]))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and the number of ids of each word."""
        raw = [w.encode() for w in words]
        long = {k: self.encode_long(r) for k, r in enumerate(raw) if len(r) > LONG_WORD}
        if long:
            others = [k for k in range(len(raw)) if k not in long]
            ids, count = self._encode_short([raw[k] for k in others])
            parts = dict(zip(others, np.split(ids, np.cumsum(count)[:-1]))) | long
            return np.concatenate([parts[k] for k in range(len(raw))]), np.array([len(parts[k]) for k in range(len(raw))], np.int64)
        return self._encode_short(raw)

    def _encode_short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = raw
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(length) - 1
        symbol[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), length)
        done_symbol, done_word = [], []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbol), len(self.keys), np.int64)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.rank[at[hit]]
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, heads)
            spread = np.repeat(best, np.diff(np.append(heads, len(symbol))))
            over = spread == len(self.keys)
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
            pick = (rank == spread) & ~over
            chosen = np.flatnonzero(pick)
            # in a run of overlapping pairs (a a a) every second one counts, from the left
            begins = np.concatenate(([True], np.diff(chosen) != 1)) if len(chosen) else np.zeros(0, bool)
            run = np.cumsum(begins) - 1
            chosen = chosen[(chosen - chosen[begins][run]) % 2 == 0] if len(chosen) else chosen
            symbol[chosen] = self.made[at[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, flat, and the first id of each text (one more entry than texts)."""
        if len(self.row) > CACHE_WORDS:
            self._forget()
        cut = [self.words(t) for t in texts]
        every = list(itertools.chain.from_iterable(cut))
        fresh = list(set(every).difference(self.row))
        if fresh:
            base = len(self.row)
            self.row.update(zip(fresh, range(base, base + len(fresh))))
            self._keep(*self.encode_words(fresh))
        if len(self.flat) > 1:
            self.flat, self.bounds = [np.concatenate(self.flat)], [np.concatenate(self.bounds)]
        counts = np.array([len(ws) for ws in cut], np.int64)
        rows = np.fromiter(map(self.row.__getitem__, every), np.int64, len(every))
        first, length = self.bounds[0][:-1][rows], np.diff(self.bounds[0])[rows]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[0][np.repeat(first - upto[:-1], length) + np.arange(upto[-1])]
        return ids.astype(np.uint32), upto[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids) -> str:
        """The vocabulary file names no decoder: tokens joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Token ids of every text: (id_col, ids array<int>). Null text: no ids."""
    def run(batches):
        bpe = WordBpe(vocabulary)
        for batch in slices(batches):
            ids, first = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=[id_col, "ids"])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The text of every list of ids, beside all other columns but one named `out`; a null list gives a null text."""
    others = [c for c in tokens.columns if c != out]
    fields = [tokens.schema[c] for c in others]

    def run(batches):
        bpe = WordBpe(vocabulary)
        for batch in batches:
            column = [None if x is None else " ".join(bpe.token[i] for i in x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(column, pa.string())], names=[*others, out])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` string"
    return tokens.select(F.col(f"`{ids}`").alias("__given_ids"), *[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema.lstrip(", "))


def round_trip_digests(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text, keeping only digests: (id, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is over the ids as little-endian 32-bit integers, decoded_sha256
    over the decoded text in UTF-8. One pass, no shuffle; memory is bounded by a
    slice of texts and CACHE_WORDS words.
    """
    def run(batches):
        bpe = WordBpe(vocabulary)
        for batch in slices(batches):
            ids, first = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            parts = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first)),
                 pa.array([sha256_hex(p.astype("<u4").tobytes()) for p in parts]),
                 pa.array([sha256_hex(bpe.decode(p).encode()) for p in parts])],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
