import cases
from pyspark.sql import functions as F

from sievewright.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert held[0] > 200 and held[1] > 0.97
    assert found.where("score NOT BETWEEN 0 AND 1").count() == 0


def test_awkward_rows(spark):
    rows = [(k, f"der die und {k} nicht" if k % 2 else f"the of and {k} not") for k in range(100, 160)] + cases.awkward()
    docs = cases.documents(spark, rows)
    net = langid.train(docs)
    assert net.languages == ["de", "en"]
    found = langid.predict(docs.withColumn("score", F.lit("old")), net)
    assert found.count() == len(rows) and found.columns[-2:] == ["lang_pred", "score"]
    by_id = {r["doc_id"]: r for r in found.collect()}
    for k in (1, 2, 3, 11):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert by_id[101]["lang_pred"] == "de" and by_id[100]["lang_pred"] == "en"


def test_text_alone_decides(spark):
    docs = cases.documents(spark, [(k, "der die und nicht ein" if k % 2 else "the of and not a") for k in range(40)])
    net = langid.train(docs)
    a = langid.narrow_predict(docs, net).select("doc_id", "lang_pred", F.round("score", 6))
    b = langid.narrow_predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), net) \
        .select("doc_id", "lang_pred", F.round("score", 6))
    assert sorted(a.collect()) == sorted(b.collect())


def test_nothing_to_learn(spark):
    empty = cases.documents(spark, [])
    net = langid.train(empty)
    assert langid.narrow_predict(empty, net).count() == 0
    assert {r["lang_pred"] for r in langid.narrow_predict(cases.documents(spark, [(1, "some text")]), net).collect()} == {"und"}


def numbered_rows(n, ids):
    return [(k % ids, f"der die und {k} nicht" if k % ids % 2 else f"the of and {k} not") for k in range(n)]


def test_sample_goes_by_rows_not_ids(spark):
    """Twelve ids over many rows, all of them with texts of their own, and one row repeated more often than all others."""
    docs = cases.documents(spark, numbered_rows(20000, 12) + [(3, "der die das")] * 20000)
    languages, x, y = langid.training_windows(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert languages == ["de", "en"] and len(y) <= langid.SAMPLE_TOTAL * langid.SAMPLE_WINDOWS and min((y == 0).sum(), (y == 1).sum()) >= 300
    net = langid.train(docs)
    assert langid.narrow_predict(docs, net).where("lang_pred <> IF(doc_id % 2 = 1, 'de', 'en')").count() == 0


def test_one_id_for_all_rows_keeps_the_bound(spark):
    docs = spark.range(0, 200000, 1, 8).selectExpr("7L AS id", "concat('text number ', id) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang")
    languages, x, _ = langid.training_windows(docs)
    assert languages == ["aa", "bb"] and len(x) == 2 * langid.SAMPLE_PER_LANG


def test_every_language_is_sampled(spark):
    """Many more languages than a table of heavy ones could hold."""
    docs = spark.range(0, 3000, 1, 8).selectExpr("id", "concat('text number ', id) AS text", "concat('l', id % 1500) AS lang")
    languages, _, _ = langid.training_windows(docs)
    assert len(languages) == 1500


def test_forward_pass_and_gradients():
    """The table look-up equals the plain convolution, and gradients equal differences of the loss."""
    import numpy as np
    rng = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b", "c"])
    x = rng.integers(0, 256, (4, langid.WINDOW + langid.AHEAD)).astype(np.uint8)
    y = np.array([0, 2, 1, 2])

    def plain(w):
        logits = np.tile(w["shift"], (len(x), 1))
        pooled = []
        for width in langid.WIDTHS:
            response = np.array([[[w["embed"][row[i:i + width]].ravel() @ w[f"conv{width}"][:, f] for f in range(langid.FILTERS)]
                                  for i in range(langid.WINDOW)] for row in x])
            pooled.append(response.max(axis=1))
        logits = logits + np.tanh(np.concatenate(pooled, axis=1) + w["bias"]) @ w["dense"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    flat = np.zeros(len(x) * langid.WINDOW + langid.AHEAD, np.uint8)
    for k, row in enumerate(x):             # a window looks ahead into the next one
        flat[k * langid.WINDOW:(k + 1) * langid.WINDOW] = row[:langid.WINDOW]
    for k in range(len(x)):
        x[k] = flat[k * langid.WINDOW:(k + 1) * langid.WINDOW + langid.AHEAD]
    np.testing.assert_allclose(net.probabilities(flat, net.tables()), plain(net.weights), rtol=2e-4)

    def loss(w):
        return -np.log(plain(w)[np.arange(len(y)), y]).mean()
    slopes, h = net._gradients(x, y), 1e-5
    for name, at in (("dense", (3, 1)), ("shift", (2,)), ("bias", (20,)), ("conv3", (5, 7)), ("embed", (int(x[0, 3]), 2))):
        up, down = ({**net.weights, name: net.weights[name].copy()} for _ in range(2))
        up[name][at] += h
        down[name][at] -= h
        assert abs((loss(up) - loss(down)) / (2 * h) - slopes[name][at]) < 1e-5
