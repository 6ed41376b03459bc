import hashlib
import heapq
import random
import zlib

import pytest

from sievewright.llm import repair
from sievewright.llm.repair import Costs

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows, costs):
    """(cost, audit) by search over (rows used, last initial): rows are (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, used, last = heapq.heappop(heap)
        if (used, last) in done:
            continue
        done.add((used, last))
        if used == len(rows) and last in ("", "a"):
            return cost, audit
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c in follows:
            if c != "s":
                heapq.heappush(heap, (cost + costs.insert, audit + "I", used, c))
            if used < len(rows) and not rows[used][1]:
                extra = costs.truncated if rows[used][2] else 0
                if rows[used][0] == c:
                    heapq.heappush(heap, (cost + extra, audit + "K", used + 1, c))
                if c != "s":
                    heapq.heappush(heap, (cost + extra + costs.rerole, audit + "R", used + 1, c))
        if used < len(rows):
            heapq.heappush(heap, (cost + costs.delete, audit + "D", used + 1, last))


def parse(rows, costs):
    return repair.best(repair.parsed(repair.shape(rows), costs))


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(rerole=3, delete=4, insert=2, truncated=1), Costs(2, 2, 2, 0), Costs(0, 1, 1, 0)])
def test_parse_against_search(costs):
    rng = random.Random(5)
    for n in [*range(1, 8)] * 8 + [13]:
        rows = [(rng.choice("suax" if rng.random() < .3 else "ua"), rng.random() < .15, rng.random() < .2) for _ in range(n)]
        assert parse(rows, costs) == cheapest(rows, costs), rows


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(2, 3, 1, 1)])
def test_blocks_combine_like_rows(costs):
    """Any cut into blocks gives what one chart over all spans gives."""
    rng = random.Random(8)
    for n in (5, 9, 17, 24):
        rows = [(rng.choice("suaax"), rng.random() < .1, rng.random() < .2) for _ in range(n)]
        whole = repair.parsed(repair.shape(rows), costs)
        for size in (1, 2, 3, 7):
            cells = [repair.parsed(repair.shape(rows[i:i + size]), costs) for i in range(0, n, size)]
            while len(cells) > 1:
                cells = [repair.chart(cells[i:i + 4], costs) for i in range(0, len(cells), 4)]
            assert cells[0] == whole


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, costs=Costs(), damage=True):
    """Rows of the contract, one conversation at a time."""
    out = []
    after = list(hurt(rows)) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in mine if t is not None]
        shape = [(r[2][:1] if r[2][:1] in ("s", "u", "a") else "x", f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)]
        cost, audit = cheapest(shape, costs)
        left, lines, place = list(mine), [], None
        for edit in audit:
            _, _, role, text = left.pop(0) if edit != "I" else (0, 0, "", "")
            if edit == "D":
                continue
            place = (-1 if edit == "K" and role[:1] == "s" else 0) if place is None else place + 1
            lines.append((role if edit == "K" else ("user", "assistant")[place % 2]) + ":" + text)
        initials = [r[2][:1] for r in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def conversations(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        system = rng.random() < .3
        if system:
            rows.append((conv, 0, "system", "Be kind."))
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Hello there.", f"Number {rng.random()}!", "no end", " \n", f"{turn} fine?  "])
            rows.append((conv, turn + system, ("user", "assistant")[turn % 2], text))
    return rows


AWKWARD = [(500, None, "user", "A."), (500, None, None, None), (500, 3, "assistant", None), (501, 1, "tool", "x."), (502, 0, "", "."), (503, 2, "system", "S!"),
           (503, 2, "user", "Same turn."), (503, 2, "assistant", "Same turn."), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (504, None, "user", "")]
SCHEMA = "conv_id long, turn long, role string, text string, pos int, block string, audit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "b", None) for r in rows], SCHEMA).repartition(5) if rows else spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("block", [2, 16])
def test_report_against_brute_force(spark, block):
    rows = conversations(60) + AWKWARD
    rng = random.Random(1)
    rows += [(900, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "Well!", f"{k}."])) for k in range(150)]     # one long conversation
    given = table(spark, rows)
    found = repair.repair_report(repair.damaged(given), given, block=block).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_cheap_insertions_and_rows(spark):
    rows = conversations(25, 4)
    given = table(spark, rows)
    costs = Costs(insert=1)
    report = repair.repair_report(given, costs=costs, block=3).collect()
    assert sorted(map(tuple, report), key=repr) == brute(rows, costs, damage=False)
    assert any("I" in r["audit"] for r in report)
    lines = {}
    for r in sorted(repair.repaired(given, costs, 3).collect(), key=lambda r: (r["conv_id"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(sha("\n".join(lines.get(r["conv_id"], []))) == r["repaired_sha256"] for r in report)


def test_nothing_left(spark):
    assert repair.repair_report(table(spark, [])).count() == 0
    given = table(spark, [(1, 0, "user", "A.")])
    assert tuple(repair.repair_report(given.limit(0), given).first()) == (1, 0, 0, 0, 0, 0, 0, "", sha(""))
