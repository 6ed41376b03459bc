"""Personal data: fixed base patterns, and a character tagger that adds spans.

Base spans follow four patterns with their checks. A bidirectional LSTM with CRF transitions
learns them from labelled spans: those of the base patterns in a bounded sample, partly
rewritten into common spellings the patterns miss (a telephone number without its plus sign, blanks
round the @, card groups parted by dots). Texts are cut into overlapping windows;
each window is decoded, and every character takes its tag from the window in which it lies
nearest to the middle, so that spans are read off the text as a whole and may be
longer than a window. A decoded span is added if it passes the check of its
kind and no base span of the kind overlaps it.

Every span of these kinds holds a digit or an @; windows without either have none and
are not decoded. The sample: SAMPLE_DOCS distinct rows whose id and text hash lowest, SAMPLE_WINDOWS
windows of each. Without any base span in it there is no tagger and nothing is added.

Null and empty texts have no spans. Offsets are code points, end exclusive. Repeated
rows are scanned alike, further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.common import row_key, row_sample, slices
from sievewright.llm.tagger import Tagger

KINDS = ["email", "ip", "card", "phone"]
WINDOW, MARGIN = 96, 24
STRIDE = WINDOW - 2 * MARGIN
SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_WINDOWS = 4000, 6, 6000
DECODE_ROWS = 2048

#: The base patterns. The look-behind only skips starts that must fail.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]")

#: Character classes of the tagger.
SIGNS = "@.-_+%() \n:,/"
LOWER, UPPER, DIGIT, LETTER, OTHER = (len(SIGNS) + k for k in range(5))
SYMBOLS = len(SIGNS) + 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    """The check a span of a kind has to pass."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in text.split(".")))
    digits = _digits(text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(found)


def _classes(points: np.ndarray) -> np.ndarray:
    table = np.full(128, OTHER, np.uint8)
    for k, c in enumerate(SIGNS):
        table[ord(c)] = k
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = LOWER, UPPER, DIGIT
    return np.where(points < 128, table[np.minimum(points, 127)], np.where(points >= 0xC0, LETTER, OTHER)).astype(np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def new_tagger() -> Tagger:
    """Tag 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k."""
    tags = 1 + 2 * len(KINDS)
    allowed = np.ones((tags, tags), bool)
    for inside in range(2, tags, 2):
        allowed[:, inside] = False
        allowed[[inside - 1, inside], inside] = True
    return Tagger(SYMBOLS, allowed, np.ones(tags, bool))


def _rewritten(text: str, kind: int) -> str:
    """A spelling of the span that the base patterns miss."""
    if kind == 0:
        return text.replace("@", " @ ")
    if kind == 3:
        return text.lstrip("+")
    if kind == 2:
        d = _digits(text)
        return ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return text


def _labelled(text: str, rng):
    """Windows of classes and tags around base spans, and one without."""
    spans, windows = base_spans(text), []
    for start, kind, end in [spans[k] for k in rng.permutation(len(spans))[:SAMPLE_WINDOWS]]:
        middle, lo = text[start:end], max(0, start - int(rng.integers(0, WINDOW)))
        hi = lo + 3 * WINDOW
        inside = [(a - lo, k, b - lo) for a, k, b in spans if a >= lo and b <= hi and (a, k, b) != (start, kind, end) and (b <= start or a >= end)]
        for new in dict.fromkeys((middle, _rewritten(middle, kind))):
            grow, at = len(new) - len(middle), start - lo
            moved = [(a, k, b) if b <= at else (a + grow, k, b + grow) for a, k, b in inside] + [(at, kind, at + len(new))]
            windows.append((text[lo:start] + new + text[end:hi], moved))
    if len(text) and not windows:
        lo = int(rng.integers(0, max(1, len(text) - WINDOW)))
        windows.append((text[lo:lo + WINDOW], []))
    for piece, inside in windows:
        codes, tags = np.full(len(piece) + 2 * WINDOW, OTHER, np.uint8), np.zeros(len(piece) + 2 * WINDOW, np.int8)
        codes[:len(piece)] = _classes(_points(piece))
        for a, k, b in sorted(inside):
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        shift = int(rng.integers(0, 24))
        yield codes[shift:shift + WINDOW], tags[shift:shift + WINDOW]


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> Tagger | None:
    """Fit the tagger on the base spans of a bounded sample."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    key = row_key("pii")

    def cut(batches):
        for batch in batches:
            for number, words in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = list(_labelled(words or "", np.random.default_rng(abs(number))))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c, _ in found], pa.binary()),
                                                  pa.array([t.tobytes() for _, t in found], pa.binary())], names=["codes", "tags"])
    sample = row_sample(named, SAMPLE_DOCS, "pii").select(key.alias("key"), "text").mapInArrow(cut, "codes binary, tags binary").toPandas()
    sample = sample.sort_values(["codes", "tags"], kind="stable")
    x = np.frombuffer(b"".join(sample["codes"]), np.uint8).reshape(-1, WINDOW)
    y = np.frombuffer(b"".join(sample["tags"]), np.int8).reshape(-1, WINDOW)
    if not y.any():
        return None
    rng = np.random.default_rng(3)
    with_spans, without = np.flatnonzero(y.any(axis=1)), np.flatnonzero(~y.any(axis=1))
    rows = np.concatenate((with_spans, rng.permutation(without)[:len(with_spans) // 2]))
    rows = rng.permutation(rows)[:TRAIN_WINDOWS]
    return new_tagger().fit(x[rows], y[rows])


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the tagger finds in every text, reconciled over its windows."""
    found: list[list] = [[] for _ in texts]
    pieces, where = [], []
    for row, text in enumerate(texts):
        if not TELLING.search(text):
            continue
        codes = _classes(_points(text))
        telling = np.flatnonzero((codes == DIGIT) | (codes == SIGNS.index("@")))
        if not len(telling):
            continue
        # window w covers [w * STRIDE - MARGIN, w * STRIDE + STRIDE + MARGIN) and decides the middle
        reach = np.unique(np.concatenate([(telling + d) // STRIDE for d in (-MARGIN - STRIDE, -MARGIN, 0, MARGIN, MARGIN + STRIDE)]))
        wanted = reach[(reach >= 0) & (reach * STRIDE < len(codes))]
        padded = np.full(len(codes) + 2 * WINDOW, OTHER, np.uint8)
        padded[MARGIN:MARGIN + len(codes)] = codes
        pieces.append(padded[wanted[:, None] * STRIDE + np.arange(WINDOW)])
        where.append((row, wanted, len(codes)))
    if not pieces:
        return found
    x = np.concatenate(pieces)
    tags = np.concatenate([tagger.decode(x[a:a + DECODE_ROWS]) for a in range(0, len(x), DECODE_ROWS)])
    middle, at = tags[:, MARGIN:MARGIN + STRIDE], 0
    for row, wanted, length in where:
        line = middle[at:at + len(wanted)]
        at += len(wanted)
        if not line.any():
            continue
        place = (wanted[:, None] * STRIDE + np.arange(STRIDE)).ravel()
        flat = line.ravel()
        keep = (place < length) & (flat > 0)
        place, flat = place[keep], flat[keep]
        begins = np.concatenate(([True], (np.diff(place) != 1) | (flat[1:] % 2 == 1) | ((flat[1:] - 1) // 2 != (flat[:-1] - 1) // 2)))
        heads = np.flatnonzero(begins)
        for a, b in zip(heads, np.append(heads[1:], len(place))):
            found[row].append((int(place[a]), int((flat[a] - 1) // 2), int(place[b - 1]) + 1))
    return found


def _tidy(text: str, start: int, kind: int, end: int):
    """The span without blanks and punctuation at its ends, if its kind's check lets it stand."""
    while start < end and text[start] in " \n.,:-/%)_":
        start += 1
    while start < end and text[end - 1] in " \n.,:-/%(_+@":
        end -= 1
    piece = text[start:end]
    if kind == 0:
        good = re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", piece)
    elif kind == 1:
        good = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", piece) and valid(1, piece)
    elif kind == 2:
        good = re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", piece) and valid(2, piece)
    else:
        good = re.fullmatch(r"\+?\(?[0-9][\x20().0-9-]+[0-9]", piece) and valid(3, piece) and len(_digits(piece)) < len(piece) - 1
    if not good or (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    return start, kind, end


def all_spans(texts: list[str], tagger: Tagger | None):
    """(start, kind, end, base?) of every text, by start and kind."""
    more = tagged_spans(texts, tagger) if tagger else [[] for _ in texts]
    for text, tagged in zip(texts, more):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        # a card or an address may look like a telephone number: what a base span covers is settled
        for span in filter(None, (_tidy(text, *s) for s in tagged)):
            if all(span[2] <= a or span[0] >= b for a, _, b in base):
                spans.append((*span, False))
        yield sorted(spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, found): an array of (kind, start, end, base) for every text."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in spans] for spans in all_spans(texts, tagger)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(item))], names=[id_col, "found"])
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, found array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """All columns of `docs`, every span of the text replaced by its kind in angle brackets. A null text stays null."""
    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            clean = []
            for words, spans in zip(texts, all_spans([t or "" for t in texts], tagger)):
                parts, at = [], 0
                for a, k, b, _ in spans:
                    if a >= at:
                        parts += [words[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                clean.append(None if words is None else "".join(parts) + words[at:])
            columns = [pa.array(clean, pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema)
