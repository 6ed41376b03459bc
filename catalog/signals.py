"""Signal features of the event series and of the vectors."""

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import F4, F5, f4, f4_values, f5, with_
from sievewright.functions import signal
from sievewright.operators import shortcuts, signals


@query("j1_peak", with_(F4) + "SELECT recording, max(abs(value)) AS peak FROM f4 GROUP BY 1")
def _(spark, sf):
    return signals.peak(f4_values(spark, sf))


@query("j2_clip_fraction", with_(F4) + """
SELECT recording, round(count(*) FILTER (WHERE abs(value) >= 0.1) / count(*), 6) AS clip_fraction FROM f4 GROUP BY 1""")
def _(spark, sf):
    return signals.clip_fraction(f4_values(spark, sf), 0.1)


@query("j3_rms_dbfs", with_(F4) + """
SELECT recording, round(CASE WHEN sum(v * v) > 0 THEN 20 * log10(sqrt(avg(v * v))) ELSE -240 END, 6) AS rms_dbfs
FROM (SELECT recording, CASE WHEN CAST(recording AS INT) % 9 = 0 THEN 0.0 ELSE value END AS v FROM f4) GROUP BY 1""")
def _(spark, sf):
    silent = F.expr("CASE WHEN CAST(recording AS INT) % 9 = 0 THEN 0D ELSE value END")
    return signals.rms_dbfs(f4_values(spark, sf).withColumn("value", silent))


@query("j4_edge_silence", with_(F4) + """
, k AS (SELECT recording, min(frame) FILTER (WHERE value > 0.3) AS a, max(frame) FILTER (WHERE value > 0.3) AS b, count(*) AS n FROM f4 GROUP BY 1)
SELECT recording, round(coalesce(a, n) / 10, 6) AS leading_s, round(coalesce(n - 1 - b, n) / 10, 6) AS trailing_s FROM k""")
def _(spark, sf):
    return signals.edge_silence(f4(spark, sf), 0.3, 10)


@query("j5_voiced_fraction", with_(F4) + """
, w AS (SELECT recording, frame // 8 AS f, sqrt(avg(value * value)) AS r FROM f4 GROUP BY 1, 2)
SELECT recording, count(*) AS frames, round(count(*) FILTER (WHERE r > 0.2) / count(*), 6) AS voiced_fraction FROM w GROUP BY 1""")
def _(spark, sf):
    return signals.voiced_fraction(f4(spark, sf), 8, 0.2)


# 16-bit steps of the vectors, amplified so that part of them saturates
PCM = """pcm AS (SELECT sample_id, list_transform(wave, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 32768, 0)))) AS pcm FROM f5)"""


def _amplified(db: str, source: str) -> str:
    return f"list_transform({source}, lambda x: round_even(greatest(-32768, least(32767, x * pow(10, ({db}) / 20.0))), 0))"


def _listed(column: str) -> str:
    return f"list_sum(list_transform({column}, lambda x: x::DOUBLE)) AS total, list_max({column}) AS top, list_min({column}) AS bottom"


def _summary(df, column):
    values = F.transform(column, lambda x: x.cast("double"))
    return df.select("sample_id", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"),
                     F.array_max(values).alias("top"), F.array_min(values).alias("bottom"))


def _pcm(spark, sf):
    return f5(spark, sf).select("sample_id", signal.to_pcm16("wave").alias("pcm"))


@query("j6_apply_gain", with_(F5, PCM) + f"SELECT sample_id, {_listed('w')} FROM (SELECT sample_id, {_amplified('9', 'pcm')} AS w FROM pcm)")
def _(spark, sf):
    return _summary(_pcm(spark, sf).withColumn("w", signal.apply_gain("pcm", 9)), "w")


@query("j7_mild_clipping", with_(F5, PCM) + f"""
, c AS (SELECT sample_id, pcm, {_amplified('-6', _amplified('6', 'pcm'))} AS w FROM pcm)
SELECT sample_id, {_listed('w')}, w = pcm AS lossless FROM c""")
def _(spark, sf):
    clipped = _pcm(spark, sf).withColumn("w", signal.mild_clipping("pcm"))
    return _summary(clipped, "w").join(clipped.select("sample_id", (F.col("w") == F.col("pcm")).alias("lossless")), "sample_id")


@query("j8_peak_normalize", with_(F5) + """
, p AS (SELECT sample_id, list_transform(wave, lambda x: x::DOUBLE) AS w FROM f5),
 q AS (SELECT sample_id, w, list_max(list_transform(w, lambda x: abs(x))) AS m FROM p)
SELECT sample_id, round(list_sum(list_transform(w, lambda x: x / m)), 6) AS total, round(list_max(w) / m, 6) AS top, round(list_min(w) / m, 6) AS bottom FROM q""")
def _(spark, sf):
    found = _summary(f5(spark, sf).withColumn("w", signal.peak_normalize("wave")), "w")
    return found.select("sample_id", *[F.round(c, 6).alias(c) for c in ("total", "top", "bottom")])


@query("j9_fixed_windows", with_(F4) + """
SELECT recording, frame // 16 AS "window", count(*) AS frames, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 6) AS rms
FROM f4 GROUP BY 1, 2 HAVING count(*) = 16""")
def _(spark, sf):
    return signals.fixed_windows(f4(spark, sf), 16)


@query("j9_fixed_windows_array", with_(F5) + """
SELECT sample_id, w AS "window", round(list_sum(list_transform(wave[w * 20 + 1 : w * 20 + 20], lambda x: x::DOUBLE)), 6) AS total
FROM f5, range(3) r(w)""")
def _(spark, sf):
    cut = f5(spark, sf).select("sample_id", F.posexplode(signal.fixed_windows("wave", 20)).alias("window", "w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select("sample_id", F.col("window").cast("bigint").alias("window"), F.round(total, 6).alias("total"))


@query("j_signal_features", with_(F4) + """
, k AS (SELECT recording, max(abs(value)) AS peak, count(*) FILTER (WHERE value >= 0.1) / count(*) AS clip, sqrt(avg(value * value)) AS r, count(*) AS n,
  min(frame) FILTER (WHERE value > 0.3) AS a, max(frame) FILTER (WHERE value > 0.3) AS b FROM f4 GROUP BY 1)
SELECT recording, peak, round(clip, 6) AS clip_fraction, round(20 * log10(r), 6) AS rms_dbfs, n / 10 AS seconds,
 coalesce(a, n) / 10 AS leading_s, coalesce(n - 1 - b, n) / 10 AS trailing_s FROM k""")
def _(spark, sf):
    found = signals.features(f4(spark, sf), 0.3, 0.1, 10)
    return found.withColumns({"clip_fraction": F.round("clip_fraction", 6), "rms_dbfs": F.round("rms_dbfs", 6)})


@query("d39_acoustic_thresholds", with_(F5) + """
, x AS (SELECT round(list_max(list_transform(wave, lambda v: abs(v::DOUBLE))), 4) AS v, label FROM f5),
 w AS (SELECT v, count(*) FILTER (WHERE label = 'fake') AS p, count(*) FILTER (WHERE label = 'real') AS q FROM x GROUP BY 1),
 t AS (SELECT sum(p) AS pa, sum(q) AS qa FROM w),
 s AS (SELECT *, sum(p) OVER (ORDER BY v) AS pu, sum(q) OVER (ORDER BY v) AS qu FROM w, t),
 r AS (SELECT avg(rk) FILTER (WHERE label = 'fake') AS mr FROM (SELECT label, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM x))
SELECT CAST(any_value(pa + qa) AS BIGINT) AS n, round(max(greatest(qu + pa - pu, pu + qa - qu, pa, qa)) / any_value(pa + qa), 6) AS best_accuracy,
 round((any_value(mr) - (any_value(pa) + 1) / 2) / any_value(qa), 6) AS auc FROM s, r""")
def _(spark, sf):
    peaks = f5(spark, sf).select("label", F.round(signal.peak_of("wave"), 4).alias("peak"))
    return shortcuts.best_threshold(peaks, "peak")
