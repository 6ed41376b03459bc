"""Repair of conversation structure: the cheapest edits that make a conversation a legal one.

A legal conversation is empty, or user and assistant in turn, from user to assistant, after at most one
system row. A row may be kept, given the role of user or assistant, or deleted; an empty row of user or
assistant may be inserted anywhere. Blank and repeated rows must go; a truncated row that stays costs extra.

Grammar. A stretch of rows derives a pair (first, last) of role initials, the ends of what it becomes, or
nothing at all (`ERASED`). In Chomsky normal form: ERASED -> delete; (c, c) -> keep a row of initial c | rerole to c | insert c;
(a, d) -> (a, b) (c, d) where bc is one of su, ua, au; X -> X ERASED | ERASED X. The whole derives ERASED, (u, a) or (s, a).
A cell of the chart holds for each of these the least (cost, audit); `closed` adds insertions at both
ends of a span until nothing gets cheaper. `chart` fills the cells of all spans of a block by length, over all
places where a span can be split.

Long conversations. Any stretch of a legal conversation derives one of the pairs, so a parse may be split anywhere, and
of two audits of the same rows, pair and cost none begins with the other (more insertions cost more). Cells of
neighbouring blocks therefore combine like those of neighbouring rows: BLOCK rows, then BLOCK blocks, then blocks of blocks are parsed
in Spark rounds, spans growing by that factor, and no task sees more than one block of a conversation. Faults, gaps and illegal
neighbours are counted along. Shapes of blocks repeat and are parsed once a task.
Only the repaired rows of one conversation, whose digest is sequential, pass through one task, in order, one at a time.

Rows go by turn (missing first), then role, then the text's digest. Missing roles and texts are one space; a missing
conversation id is a conversation of its own. An empty table gives no rows, further columns are ignored; a very long text is
looked at once for its faults and once for the result.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievewright.llm.common import in_batches, numbered, row_groups
from sievewright.session import settled

BLOCK = 16          # rows, or blocks, that one chart spans
ERASED = ""
LEGAL = frozenset(("su", "ua", "au"))
ROLES = {"u": "user", "a": "assistant"}
GONE, OPEN = "-", "~"       # in a shape: a row that must go; the mark of a truncated row before its initial


class Costs(NamedTuple):
    """All at least 0, `insert` at least 1: with free insertions there is no shortest audit."""
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# ---- parsing: a cell is {pair: (cost, audit)} ----

def _better(cell: dict, pair: str, offer: tuple) -> bool:
    if pair not in cell or offer < cell[pair]:
        cell[pair] = offer
        return True
    return False


def _joined(left: str, right: str) -> str | None:
    """The pair of two neighbouring stretches, None if they may not meet."""
    if not left or not right:
        return left or right
    return left[0] + right[1] if left[1] + right[0] in LEGAL else None


#: What two stretches become, by their pairs.
RULES = {(a, b): c for a in ("", "ss", "su", "sa", "uu", "ua", "au", "aa") for b in ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
         for c in [_joined(a, b)] if c is not None}


def _combine(into: dict, left: dict, right: dict) -> None:
    for a, (cost_a, audit_a) in left.items():
        for b, (cost_b, audit_b) in right.items():
            pair = RULES.get((a, b))
            if pair is not None and (pair not in into or cost_a + cost_b <= into[pair][0]):
                _better(into, pair, (cost_a + cost_b, audit_a + audit_b))


def closed(cell: dict, costs: Costs) -> dict:
    """The cell with every insertion before or after its stretch that makes some pair cheaper."""
    changed = True
    while changed:
        changed = False
        for pair, (cost, audit) in list(cell.items()):
            for c in ROLES:
                for longer, text in ((_joined(pair, c + c), audit + "I"), (_joined(c + c, pair), "I" + audit)):
                    if longer is not None:
                        changed |= _better(cell, longer, (cost + costs.insert, text))
    return cell


def row_cell(initial: str, must_go: bool, truncated: bool, costs: Costs) -> dict:
    """The cell of one row."""
    cell = {ERASED: (costs.delete, "D")}
    if not must_go:
        extra = costs.truncated if truncated else 0
        if initial in ("s", "u", "a"):
            cell[initial * 2] = (extra, "K")
        for c in ROLES:
            _better(cell, c + c, (extra + costs.rerole, "R"))
    return closed(cell, costs)


def chart(cells: list[dict], costs: Costs) -> dict:
    """The cell of a whole run of neighbouring stretches: all spans by length, over all splits."""
    spans = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            cell: dict = {}
            for split in range(i + 1, i + length):
                _combine(cell, spans[i, split], spans[split, i + length])
            spans[i, i + length] = closed(cell, costs)
    return spans[0, len(cells)]


def shape(initials_and_faults) -> str:
    """Rows as text: what the parse depends on."""
    return "".join(GONE if gone else (OPEN if truncated else "") + (initial if initial in ("s", "u", "a") else "x")
                   for initial, gone, truncated in initials_and_faults)


@functools.lru_cache(maxsize=1 << 16)
def parsed(word: str, costs: Costs) -> dict:
    """The cell of a block of rows by its shape."""
    cells, truncated = [], False
    for c in word:
        if c == OPEN:
            truncated = True
            continue
        cells.append(row_cell(c, c == GONE, truncated, costs))
        truncated = False
    return chart(cells, costs)


def best(cell: dict) -> tuple[int, str]:
    return min(cell[pair] for pair in (ERASED, "ua", "sa") if pair in cell)


def applied(audit: str, rows):
    """(role, text) of the repaired conversation; takes the rows one at a time."""
    place, rows = None, iter(rows)
    for edit in audit:
        role = text = ""
        if edit != "I":
            role, text = next(rows)
            if edit == "D":
                continue
        if place is None:
            place = -1 if edit == "K" and role[:1] == "s" else 0
        if edit != "K":
            role = "user" if place % 2 == 0 else "assistant"
        place += 1
        yield role, text


# ---- Spark ----

NODE = ("cells array<struct<pair: string, cost: long, audit: string>>, blank long, duplicate long, truncated long, illegal long, "
        "turns long, low long, high long, first_turn long, last_turn long, first string, last string")
NODE_TYPES = [pa.list_(pa.struct([("pair", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])), *[pa.int64()] * 9, pa.string(), pa.string()]
NODE_NAMES = [part.split()[0] for part in NODE.replace("pair: string, cost: long, audit: string", "").split(", ")]


def _as_cells(cell: dict) -> list[dict]:
    return [{"pair": p, "cost": c, "audit": a} for p, (c, a) in sorted(cell.items())]


def _row_node(members, costs: Costs) -> tuple:
    """The node of up to BLOCK rows (turn, initial, fault)."""
    turns = [t for t, _, _ in members if t is not None]
    initials = [i for _, i, _ in members]
    faults = [f for _, _, f in members]
    cell = parsed(shape((i, f in ("blank", "duplicate"), f == "truncated") for _, i, f in members), costs)
    return (_as_cells(cell), *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), len(set(turns)), min(turns, default=None), max(turns, default=None),
            turns[0] if turns else None, turns[-1] if turns else None, initials[0], initials[-1])


def _merged(nodes: list[tuple], costs: Costs) -> tuple:
    """The node of up to BLOCK neighbouring nodes."""
    if len(nodes) == 1:
        return nodes[0]
    cells = [{c["pair"]: (c["cost"], c["audit"]) for c in n[0]} for n in nodes]
    blank, duplicate, truncated, illegal, turns = (sum(n[k] for n in nodes) for k in range(1, 6))
    illegal += sum(a[11] + b[10] not in LEGAL for a, b in zip(nodes, nodes[1:]))
    known = [n for n in nodes if n[6] is not None]      # missing turns come first, so those with turns are neighbours
    turns -= sum(a[9] == b[8] for a, b in zip(known, known[1:]))
    return (_as_cells(chart(cells, costs)), blank, duplicate, truncated, illegal, turns, min((n[6] for n in known), default=None),
            max((n[7] for n in known), default=None), known[0][8] if known else None, known[-1][9] if known else None, nodes[0][10], nodes[-1][11])


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, fault, pos, size) of every row, `fault` the first of blank, duplicate and truncated."""
    narrow = settled(rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("name"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").alias("own")), "turns")
    placed = settled(numbered(narrow, ["conv_id"], [F.col("turn"), F.col("role"), F.col("name")], name="turns-in-order"), "numbered-turns")
    firsts = placed.groupBy("conv_id", "role", "name").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("name").alias("__t"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("name") == F.col("__t"))
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("pos") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return placed.join(firsts, same, "left").select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "pos", "size")


def cheapest(rows: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    kind, arrow = _id_types(rows)

    def first(batches):
        def nodes():
            for (conv, at), members in row_groups(batches, 2):
                members = list(members)
                yield conv, at, -(-members[0][3] // block), *_row_node([m[4:] for m in members], costs)
        yield from in_batches(nodes(), ["conv_id", "pos", "size", *NODE_NAMES], [arrow, pa.int64(), pa.int64(), *NODE_TYPES])

    def further(batches):
        def nodes():
            for (conv, at), members in row_groups(batches, 2):
                members = list(members)
                yield conv, at, -(-members[0][3] // block), *_merged([m[4:] for m in members], costs)
        yield from in_batches(nodes(), ["conv_id", "pos", "size", *NODE_NAMES], [arrow, pa.int64(), pa.int64(), *NODE_TYPES])

    def dealt(table, *columns):
        found = table.withColumn("block", F.floor(F.col("pos") / block)).select("conv_id", "block", "pos", "size", *columns)
        return found.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")

    schema = f"conv_id {kind}, pos long, size long, {NODE}"
    turn = F.col("turn").cast("long").alias("turn")
    nodes = settled(dealt(faulty(rows), turn, "initial", "fault").mapInArrow(first, schema), "spans")
    while (nodes.agg(F.max("size")).first()[0] or 1) > 1:
        nodes = settled(dealt(nodes, *NODE_NAMES).mapInArrow(further, schema), "spans")
    ends = F.filter("cells", lambda c: c["pair"].isin(ERASED, "ua", "sa"))
    chosen = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return nodes.withColumn("chosen", chosen).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                                                     "chosen.cost", "chosen.audit")


def _id_types(rows: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type
    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _reports_and_rows(rows: DataFrame, reports: DataFrame, everyone: DataFrame) -> DataFrame:
    """Reports, ids and rows of every conversation in one stream, sorted within partitions: kind 0, 1 and 2."""
    none = {**{n: F.lit(None).cast("long") for n in NUMBERS}, "audit": F.lit(None).cast("string")}
    order = {"turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    heads = reports.select("conv_id", F.lit(0).alias("kind"), *NUMBERS, "audit", *[v.alias(k) for k, v in order.items()])
    ids = everyone.select("conv_id").distinct().select("conv_id", F.lit(1).alias("kind"), *[v.alias(k) for k, v in {**none, **order}.items()])
    body = rows.select("conv_id", F.lit(2).alias("kind"), *[v.alias(k) for k, v in none.items()], *order)
    return heads.unionByName(ids).unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", F.sha2("text", 256))


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for missing roles and texts."""
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _conversations(batches):
    """(conv, report, rows) of every conversation of a sorted stream; the rows must be used before the next is asked for."""
    for (conv,), members in row_groups(batches, 1):
        report = None
        rows = (m for m in members)
        head = next(rows)
        if head[1] == 0:
            report = head[2:9]
        yield conv, report, ((m[10], m[11]) for m in rows if m[1] == 2)


def repaired(rows: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text): the rows of every repaired conversation, by place from 0."""
    kind, arrow = _id_types(rows)
    rows = plain(rows)

    def run(batches):
        def found():
            for conv, report, texts in _conversations(batches):
                if report:
                    for place, (role, text) in enumerate(applied(report[-1], texts)):
                        yield conv, place, role, text
        yield from in_batches(found(), ["conv_id", "place", "role", "text"], [arrow, pa.int64(), pa.string(), pa.string()], 256)
    return _reports_and_rows(rows, cheapest(rows, costs, block), rows).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repair_report(rows: DataFrame, everyone: DataFrame | None = None, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    `everyone` may name conversations of which no row is left; they have zeros, an empty audit and the digest of nothing.
    """
    kind, arrow = _id_types(rows)
    rows = plain(rows)

    def run(batches):
        def found():
            for conv, report, texts in _conversations(batches):
                digest = hashlib.sha256()
                for place, (role, text) in enumerate(applied(report[-1], texts) if report else ()):
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield (conv, *(report or (0, 0, 0, 0, 0, 0, "")), digest.hexdigest())
        yield from in_batches(found(), ["conv_id", *NUMBERS, "audit", "repaired_sha256"], [arrow, *[pa.int64()] * 6, pa.string(), pa.string()])
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string"
    return _reports_and_rows(rows, cheapest(rows, costs, block), rows if everyone is None else everyone).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults: by the checksum of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    sentence ends (2), is repeated (3) or becomes the user's (4). Missing values are one space."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    kind = F.crc32(name) % 20
    rows = plain(conversations).withColumn("__kind", kind).where("__kind <> 0")
    text: Column = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__time")).drop("__time")
