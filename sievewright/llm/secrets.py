"""Secret scanning: all rules in one automaton, one pass over the bytes of every text.

Base kinds are `assign`, `access` and `hex`; further kinds add spans of common key formats.
A span is kind:start:end in code points, end exclusive. Matches of one kind never overlap;
a match that is too short uses up its characters and is dropped. Null and empty texts have no spans; lines
need not be short: texts are cut only at bytes no match can hold. Repeated rows
are scanned alike, further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievewright.llm.automaton import Automaton, Rule
from sievewright.llm.common import sha256_hex, slices, text_buffers

#: The base rules, in their order, then the added ones.
BASE_RULES = [
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8, True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
]
MORE_RULES = [
    Rule("hub", "gh[pousr]_", "[A-Za-z0-9]", 8),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 8),
    Rule("pem", "-----BEGIN( [A-Z]+)? PRIVATE KEY----", "-", 1),
]


def scan(batch_text, automaton: Automaton) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) in code points of every text, by start and rule."""
    data, offsets = text_buffers(batch_text)
    found: list[list] = [[] for _ in range(len(offsets) - 1)]
    spans = automaton.spans(data, offsets)
    if spans:
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        for rule, start, end in spans:
            row = int(np.searchsorted(offsets, start, "right")) - 1
            base = points[offsets[row]]
            found[row].append((int(points[start] - base), rule, int(points[end] - base)))
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", more=tuple(MORE_RULES)) -> DataFrame:
    """(id_col, found): an array of (kind, start, end) for every text."""
    rules = [*BASE_RULES, *more]
    automaton = Automaton(rules)        # compiled once; tasks receive the arrays

    def run(batches):
        for batch in slices(batches):
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in scan(batch.column("text"), automaton)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=[id_col, "found"])
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, found array<struct<kind: string, start: long, end: long>>")


def digests(spans: DataFrame, base: list[str], id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the text of all spans."""
    def run(batches):
        for batch in batches:
            found = [f or [] for f in batch.column("found").to_pylist()]
            written = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in f] for f in found]
            plain = [[s.get("base", s["kind"] in base) for s in f] for f in found]
            basic = [",".join(w for w, p in zip(ws, ps) if p) for ws, ps in zip(written, plain)]
            counts = [pa.array([sum(s["kind"] == k and p for s, p in zip(f, ps)) for f, ps in zip(found, plain)], pa.int64()) for k in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *counts, pa.array([sha256_hex(b.encode()) for b in basic]), pa.array([",".join(w) for w in written])],
                names=[id_col, *[f"n_{k}" for k in base], "base_sha256", "spans"])
    kind = spans.schema[id_col].dataType.simpleString()
    return spans.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")
