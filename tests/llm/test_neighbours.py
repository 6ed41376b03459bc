import numpy as np
import pytest

from sievewright.llm import neighbours, queries


def brute(rows, every=50, k=5):
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = [(-np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in good if i != q]
            out[q] = sorted(scores)[:k]
    return out


def recall(found, expected, k=5):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, best in expected.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        floor = -best[-1][0] - 1e-9 if best else 0
        hits += sum(m[2] >= floor for m in mine)
        total += len(best)
    assert set(got) <= set(expected)
    return hits / max(1, total)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(queries.QUERIES["op7_nearest"](spark, sf).collect(), brute(rows)) >= 0.9


def test_hot_vector_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=12).tolist()
    rows = [(k, hot if k % 3 == 0 else rng.normal(size=12).tolist()) for k in range(600)]
    rows += [(5000, None), (5050, []), (5100, [0.0] * 12), (5150, [float("nan")] + [1.0] * 11), (5200, [None] + [1.0] * 11), (5250, [1.0, 2.0]),
             (None, hot), (0, hot), (5300, [float("inf")] + [1.0] * 11)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string").repartition(6)
    expected = brute([r for r in rows if r[1] is None or len(r[1]) == 12])
    found = neighbours.nearest(table).collect()
    assert recall(found, expected) >= 0.9
    ties = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 300)
    assert ties == [(1, 0), (2, 3), (3, 6), (4, 9), (5, 12)]


def test_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, neighbours.nearest(table).collect()))
    assert [f[:3] for f in found] == [(0, 1, 2), (0, 2, 1)] and found[0][3] == pytest.approx(0.5 ** 0.5)


def test_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-320])
def test_extreme_components(spark, size):
    """Finite vectors whose squares are not have scores like any other."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(120, 6)).round(1 if size < 1e-300 else 6)
    plain[plain == 0] = 0.5
    rows = [(k, (plain[k] * (size if k % 2 else 1.0)).tolist()) for k in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    reference = [(k, (np.array(v) / np.abs(v).max()).tolist()) for k, v in rows]
    found = neighbours.nearest(table, every=10).collect()
    assert all(r["score"] is not None and abs(r["score"]) <= 1 + 1e-12 for r in found)
    assert recall(found, brute(reference, every=10)) >= 0.9


def test_queries_share_leaves_and_units(spark, monkeypatch):
    """A search gives the same rows whichever queries are compared together and however cells share units."""
    sf = "/root/testdata/sf0.1"
    whole = sorted(map(tuple, queries.QUERIES["op7_nearest"](spark, sf).collect()))
    monkeypatch.setattr(neighbours, "TOGETHER", 3)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    monkeypatch.setattr(neighbours, "UNITS", 7)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    assert sorted(map(tuple, queries.QUERIES["op7_nearest"](spark, sf).collect())) == whole


def test_units(monkeypatch):
    """Neighbouring cells share a unit up to its size; a large cell has units of its own."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    first, blocks = neighbours.units_of([4, 5, 2, 35, 1, 0, 9, 1], 64)
    assert first.tolist() == [0, 0, 1, 2, 6, 6, 6, 7] and blocks.tolist() == [1, 1, 1, 4, 1, 1, 1, 1]
    monkeypatch.setattr(neighbours, "UNITS", 2)
    assert neighbours.units_of([8] * 8, 64)[0].tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    monkeypatch.setattr(neighbours, "UNIT_BYTES", 16 * 8 * 64)
    assert neighbours.units_of([8] * 8, 64)[0].tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_each_vector_is_shuffled_once(spark, monkeypatch):
    """Points are made by one shuffle; a visit sends points and queries by one; its results need one more."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    sound = neighbours.sound_vectors(table, "vec_id", "embedding")
    plan = neighbours.distinct_points(sound, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    plan = neighbours.nearest(table)._jdf.queryExecution().executedPlan().toString()
    results, visit = plan[:plan.index("MapInArrow")], plan[plan.index("MapInArrow"):]
    assert results.count("Exchange ") == 1 and visit.count("Exchange hashpartitioning(unit") == 1
    assert "CoGroup" not in plan and "explode" not in plan      # no copies of points for parts of the queries


def test_rows_whose_vectors_differ_in_length_only(spark):
    """An identifier with a vector and twice that vector is one neighbour and one query."""
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(60, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(plain)] + [(k, (2 * v).tolist()) for k, v in enumerate(plain)]
    found = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()))
    expected = brute(rows[:60], every=10)
    assert [(q, i) for q, _, i, _ in found] == [(q, i) for q in sorted(expected) for _, i in expected[q]]
