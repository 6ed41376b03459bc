"""Splits by group, by row and by attribute."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import F1, F3, f1, f3, with_
from sievewright.operators import splits


@query("e13_group_shuffle_split", with_(F1) + """
, v AS (SELECT sample_id, CASE WHEN order_key % 29 = 0 THEN 'UNKNOWN_SPEAKER' ELSE speaker_id END AS g FROM f1),
 r AS (SELECT g, row_number() OVER (ORDER BY sha256('42|' || g), g) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM v)),
 t AS (SELECT *, n * 70 // 100 AS a FROM r), u AS (SELECT *, (n - a) // 2 AS b FROM t)
SELECT sample_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'validation' ELSE 'test' END AS split FROM v JOIN u USING (g)""")
def _(spark, sf):
    rows = f1(spark, sf).selectExpr("sample_id", "CASE WHEN order_key % 29 = 0 THEN NULL ELSE speaker_id END AS speaker_id")
    return splits.group_shuffle_split(rows, "speaker_id").select("sample_id", "split")


@query("e13_hash_split", with_(F1) + """
, v AS (SELECT sample_id, CASE WHEN order_key % 29 = 0 THEN 'UNKNOWN_SPEAKER' ELSE speaker_id END AS g FROM f1),
 h AS (SELECT sample_id, ('0x' || left(sha256('42|' || g), 13))::BIGINT::HUGEINT AS point FROM v)
SELECT sample_id, CASE WHEN point * 100 < 70 * 16::HUGEINT ** 13 THEN 'train' WHEN point * 100 < 85 * 16::HUGEINT ** 13 THEN 'validation' ELSE 'test' END AS split FROM h""")
def _(spark, sf):
    rows = f1(spark, sf).selectExpr("sample_id", "CASE WHEN order_key % 29 = 0 THEN NULL ELSE speaker_id END AS speaker_id")
    return splits.hash_split(rows, "speaker_id").select("sample_id", "split")


@query("e16_row_split", with_(F1) + """
, r AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('42|' || sample_id), sample_id) AS rn, count(*) OVER () AS n FROM f1)
SELECT sample_id, CASE WHEN rn <= n * 70 // 100 THEN 'train' WHEN rn <= n * 70 // 100 + n * 15 // 100 THEN 'validation' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    return splits.row_split(f1(spark, sf).select("sample_id"), "sample_id")


def greedy_sql(rows: str, key: str, by: str, targets: str) -> str:
    """The sequential loop as a recursive query: step i places the i-th group of every stratum.

    Deficits are whole numbers in units of 1/100 row.
    """
    return f""", g AS (SELECT {by} AS st, {key} AS k, count(*) AS size FROM {rows} GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY size DESC, k) AS i, sum(size) OVER (PARTITION BY st) AS n FROM g),
 f AS (SELECT st, i, k, size, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, {targets} FROM o WHERE i = 1)
  UNION ALL
  SELECT st, i, k, size, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END FROM
  (SELECT o.st, o.i, o.k, o.size, f.a - CASE WHEN f.split = 'train' THEN f.size * 100 ELSE 0 END AS a,
     f.b - CASE WHEN f.split = 'validation' THEN f.size * 100 ELSE 0 END AS b, f.c - CASE WHEN f.split = 'test' THEN f.size * 100 ELSE 0 END AS c
   FROM f JOIN o ON o.st = f.st AND o.i = f.i + 1))"""


_PERCENT = "n * 70 AS a, n * 15 AS b, n * 15 AS c"


@query("e14_greedy_split", "WITH RECURSIVE " + F3 + greedy_sql("f3", "entity", "generator", _PERCENT) + """
SELECT st AS stratum, k AS entity, size, split AS new_split FROM f""")
def _(spark, sf):
    return splits.greedy_assignment(f3(spark, sf), "entity", by="generator")


@query("e14_greedy_split_rows", "WITH RECURSIVE " + F1 + greedy_sql("f1", "speaker_id", "''", _PERCENT) + """
SELECT sample_id, f.split FROM f1 JOIN f ON f.k = f1.speaker_id""")
def _(spark, sf):
    return splits.greedy_split(f1(spark, sf), "speaker_id").select("sample_id", "split")


@query("e14_greedy_split_targets", "WITH RECURSIVE " + F1 + greedy_sql(
    "f1", "speaker_id", "source_dataset", "170000 AS a, 60000 AS b, 30000 AS c") + """
SELECT st AS stratum, k AS speaker_id, size, split AS new_split FROM f""")
def _(spark, sf):
    return splits.greedy_assignment(f1(spark, sf), "speaker_id", {"train": 1700, "validation": 600, "test": 300}, "source_dataset")


def multi_sql(frame, key, attributes, shares) -> str:
    """Sequential placement by (fit - overshoot / 2, fewer rows held), one group per recursion step.

    Neither table leaves a split without a value, so the supplying pass has nothing to do.
    """
    names, n = list(shares), range(len(attributes))
    counts_ = ", ".join(f"count(*) FILTER (WHERE generator = '{a}') AS c{i}" for i, a in enumerate(attributes))
    goals = ", ".join(f"sum(c{i}) OVER () * {p} AS g{s}{i}" for s, p in shares.items() for i in n)
    state = [f"h{s}{i}" for s in names for i in n]
    score = {s: "(" + " + ".join(f"least(c{i}, greatest(0.0, g{s}{i} - h{s}{i}))" for i in n) + ") - 0.5 * ("
             + " + ".join(f"greatest(0.0, h{s}{i} + c{i} - g{s}{i})" for i in n) + ")" for s in names}
    load = {s: " + ".join(f"h{s}{i}" for i in n) for s in names}
    held = ", ".join(state)
    after = ", ".join(f"h{s}{i} + CASE WHEN split = '{s}' THEN c{i} ELSE 0 END AS h{s}{i}" for s in names for i in n)
    # a later split wins only with a strictly better (score, -load)
    first, second, third = names
    better = lambda a, b: f"(s{b} > s{a} OR (s{b} = s{a} AND l{b} < l{a}))"
    pick = (f"CASE WHEN {better(first, second)} THEN CASE WHEN {better(second, third)} THEN '{third}' ELSE '{second}' END "
            f"WHEN {better(first, third)} THEN '{third}' ELSE '{first}' END AS split")
    scored = ", ".join(f"{score[s]} AS s{s}, {load[s]} AS l{s}" for s in names)
    columns = f"k, i, total, {', '.join(f'c{j}' for j in n)}, {', '.join(f'g{s}{j}' for s in names for j in n)}, {held}"
    return f""", g AS (SELECT {key} AS k, count(*) AS total, {counts_} FROM {frame} GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY total DESC, {', '.join(f'c{j}' for j in n)}, k NULLS FIRST) AS i, {goals} FROM g),
 f AS (SELECT {columns}, {pick} FROM (SELECT *, {scored} FROM (SELECT *, {', '.join(f'0 AS {h}' for h in state)} FROM o WHERE i = 1))
  UNION ALL SELECT {columns}, {pick} FROM (SELECT *, {scored} FROM (
   SELECT o.*, {', '.join(f'p.{h}' for h in state)} FROM (SELECT i, {after} FROM f) p JOIN o ON o.i = p.i + 1)))
SELECT k AS group_key, total, split AS new_split FROM f"""


SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}
MANY = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("e15_greedy_split_multi", "WITH RECURSIVE " + F3 + multi_sql("f3", "entity", ["A", "N", "R"], SHARES))
def _(spark, sf):
    return splits.greedy_split_multi(f3(spark, sf), "entity", "generator", ["A", "N", "R"])


@query("e15_greedy_split_multi_many", "WITH RECURSIVE " + F1 + multi_sql("f1", "speaker_id", MANY, SHARES))
def _(spark, sf):
    return splits.greedy_split_multi(f1(spark, sf), "speaker_id", "generator", MANY)
