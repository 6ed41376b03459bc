"""The numbered operators bound to the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register `fn(spark, sf_dir)` under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op10_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded text of every document."""
    from sievewright.llm import bpe
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


@query()
def op2_language_id(spark, sf_dir):
    """Predicted language of every document; trained on documents outside the held-out fold."""
    from pyspark.sql import functions as F
    from sievewright.llm import langid
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(langid.fold() != 1))
    folded = docs.select("doc_id", (langid.fold() == 1).alias("held_out"), "text")
    return langid.narrow_predict(folded, net, keep=("doc_id", "held_out"))


@query()
def op5_mix(spark, sf_dir):
    """How many words of every document the mix takes."""
    from sievewright.llm import mixing
    return mixing.Mixer(table(spark, sf_dir, "documents")).per_document()


@query("""
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY normal) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size
          FROM (SELECT doc_id, normal, sha256(normal) AS text_sha256
                FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
                      FROM documents)))
""")
def op4_exact_dedup(spark, sf_dir):
    """Which row of each group of equal texts stays."""
    from sievewright.llm import exact
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op6_ngram_join(spark, sf_dir):
    """Class and number of links of every document at a five-word Jaccard of 0.8."""
    from sievewright.llm import ngram_join
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


@query("""
    WITH RECURSIVE lines AS (
        SELECT doc_id, pos, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS filled
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, filled ORDER BY pos) AS ord FROM lines),
    names AS (
        SELECT 1::BIGINT AS depth, doc_id, ord, md5(line) AS name FROM numbered WHERE filled
        UNION ALL
        SELECT a.depth * 2, a.doc_id, a.ord, md5(a.name || b.name)
        FROM names a JOIN names b ON a.doc_id = b.doc_id AND b.ord = a.ord + a.depth),
    later AS (SELECT *, row_number() OVER (PARTITION BY depth, name ORDER BY doc_id, ord) > 1 AS copy FROM names),
    depths AS (SELECT doc_id, max(depth) AS run_depth FROM later WHERE copy GROUP BY doc_id),
    marked AS (SELECT n.*, coalesce(l.copy, false) AS gone FROM numbered n
               LEFT JOIN later l ON n.filled AND l.depth = 1 AND l.doc_id = n.doc_id AND l.ord = n.ord),
    stretches AS (SELECT doc_id, island, count(*) AS n FROM (
                      SELECT doc_id, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM marked WHERE gone) GROUP BY ALL),
    runs AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM stretches GROUP BY doc_id),
    kept AS (SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
                    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
    SELECT doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run,
           coalesce(run_depth, 0) AS run_depth, kept_sha256
    FROM kept LEFT JOIN runs USING (doc_id) LEFT JOIN depths USING (doc_id)
""")
def op3_line_dedup(spark, sf_dir):
    """What line de-duplication leaves of every document."""
    from sievewright.llm import line_dedup
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query()
def op9_secrets(spark, sf_dir):
    """Spans of secrets in every document."""
    from sievewright.llm import secrets
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return secrets.digests(found, [r.kind for r in secrets.BASE_RULES])


@query()
def op1_personal_data(spark, sf_dir):
    """Spans of personal data in every document."""
    from sievewright.llm import pii, secrets
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(pii.find_personal_data(docs, pii.train(docs)), pii.KINDS)


@query()
def op7_nearest(spark, sf_dir):
    """The five nearest rows of every fiftieth vector."""
    from sievewright.llm import neighbours
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op8_substring_dedup(spark, sf_dir):
    """What removing copied windows of twenty words leaves of every document."""
    from sievewright.llm import recompression
    return recompression.dedup_substrings(table(spark, sf_dir, "documents"), texts=False)


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text."""
    return (f"xor(4294967295::BIGINT, list_reduce(list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), lambda crc, b: "
            "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor(crc, b)), "
            "4294967295::BIGINT))")


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query(f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
               CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AND text IS NOT NULL THEN {_leaf_sql("replace(text, chr(10), '')")} END AS new
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                      count(*) OVER (PARTITION BY source) AS n FROM leaves),
    tree AS (SELECT 0 AS lvl, source, pos, n, leaf AS digest FROM placed
             UNION ALL
             SELECT lvl + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1
             GROUP BY lvl, source, pos // 3, n),
    subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
    upper AS (SELECT 0 AS lvl, place AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots
              UNION ALL
              SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
    low AS (SELECT doc_id, source, pos AS start, 0 AS lvl, pos, n, coalesce(new, leaf) AS cur, '' AS path FROM placed
            UNION ALL
            SELECT f.doc_id, f.source, f.start, f.lvl + 1, f.pos // 3, (f.n + 2) // 3,
                   sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.cur ELSE t.digest END, '' ORDER BY t.pos)),
                   f.path || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
            FROM low f JOIN tree t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3
            WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.start, f.lvl, f.pos, f.n, f.cur, f.path),
    high AS (SELECT l.doc_id, l.source, l.start, s.subroot, 0 AS lvl, s.place AS pos, (SELECT count(*) FROM subroots) AS n, l.cur, l.path
             FROM low l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source WHERE l.n = 1
             UNION ALL
             SELECT f.doc_id, f.source, f.start, f.subroot, f.lvl + 1, f.pos // 3, (f.n + 2) // 3,
                    sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.cur ELSE t.digest END, '' ORDER BY t.pos)),
                    f.path || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
             FROM high f JOIN upper t ON t.lvl = f.lvl AND t.pos // 3 = f.pos // 3
             WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.start, f.subroot, f.lvl, f.pos, f.n, f.cur, f.path)
    SELECT h.doc_id, p.leaf, h.subroot, r.digest AS root, sha256(h.path) AS proof_sha256, h.cur AS folded_root, h.cur = r.digest AS verified
    FROM high h JOIN placed p ON p.source IS NOT DISTINCT FROM h.source AND p.pos = h.start, (SELECT digest FROM upper WHERE n = 1) r WHERE h.n = 1
""")
def op12_merkle_manifest(spark, sf_dir):
    """Proof and tampering check of every document."""
    from sievewright.llm import merkle
    return merkle.proofs(table(spark, sf_dir, "documents")).drop("copied")


def _plus(cell: str, cost: str, edit: str) -> str:
    return f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || {edit}}}"


def _inserted(c: list[str]) -> str:
    """Struct of the four states after the insertions that help: none yet, system, user and assistant last."""
    u = f"least({c[2]}, {_plus(c[0], '5', chr(39) + 'I' + chr(39))}, {_plus(c[1], '5', chr(39) + 'I' + chr(39))}, {_plus(c[3], '5', chr(39) + 'I' + chr(39))})"
    a = f"least({c[3]}, {_plus(c[2], '5', chr(39) + 'I' + chr(39))}, {_plus(c[0], '10', chr(39) + 'II' + chr(39))}, {_plus(c[1], '10', chr(39) + 'II' + chr(39))})"
    return f"{c[0]} AS s0, {c[1]} AS s1, {u} AS s2, {a} AS s3"


_LOST = "{'c': 1000000000, 'a': ''}"
_OLD = ["p.s0", "p.s1", "p.s2", "p.s3"]


def _stay(cell: str, target: str) -> str:
    edit = f"CASE WHEN o.initial = '{target}' THEN 'K' ELSE 'R' END"
    return _plus(cell, f"CASE WHEN o.gone THEN 1000000000 WHEN o.initial = '{target}' THEN 0 ELSE 1 END + o.extra", edit)


_STEP = ", ".join([
    f"{_plus('p.s0', '2', chr(39) + 'D' + chr(39))} AS t0",
    f"least({_plus('p.s1', '2', chr(39) + 'D' + chr(39))}, {_plus('p.s0', 'CASE WHEN o.gone OR o.initial <> ' + chr(39) + 's' + chr(39) + ' THEN 1000000000 ELSE o.extra END', chr(39) + 'K' + chr(39))}) AS t1",
    f"least({_plus('p.s2', '2', chr(39) + 'D' + chr(39))}, {_stay('p.s0', 'u')}, {_stay('p.s1', 'u')}, {_stay('p.s3', 'u')}) AS t2",
    f"least({_plus('p.s3', '2', chr(39) + 'D' + chr(39))}, {_stay('p.s2', 'a')}) AS t3"])


@query(f"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
    hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS again FROM given WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen
               FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt)),
    o AS (SELECT *, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
                 CASE WHEN i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS odd
          FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                               WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed)),
    p AS (SELECT conv_id, 0::BIGINT AS i, {_inserted(["{'c': 0, 'a': ''}", _LOST, _LOST, _LOST])} FROM (SELECT DISTINCT conv_id FROM o)
          UNION ALL
          SELECT conv_id, i, {_inserted(["t0", "t1", "t2", "t3"])} FROM (
              SELECT o.conv_id, o.i, {_STEP} FROM p JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i + 1)),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, sum(odd)::BIGINT AS illegal
               FROM o GROUP BY conv_id),
    chosen AS (SELECT c.*, least(p.s0, p.s3).c::BIGINT AS cost, least(p.s0, p.s3).a AS audit
               FROM counts c JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n),
    edits AS (SELECT conv_id, pos, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i
              FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM chosen)),
    stays AS (SELECT e.conv_id, e.pos, e.edit, CASE WHEN edit = 'I' THEN '' ELSE o.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE o.text END AS text,
                     row_number() OVER (PARTITION BY e.conv_id ORDER BY pos) AS place
              FROM edits e JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.i = e.i WHERE edit <> 'D'),
    turns AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM stays),
    lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                                || ':' || text, chr(10) ORDER BY place)) AS digest FROM turns GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id
""")
def op13_conversation_repair(spark, sf_dir):
    """Faults of every damaged conversation and its cheapest repair."""
    from sievewright.llm import repair
    given = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(given), given)


@query()
def op11_toxicity(spark, sf_dir):
    """Toxicity of every document; trained on labelled documents outside the held-out fold."""
    from pyspark.sql import functions as F
    from sievewright.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs.where(toxicity.fold() != 2), table(spark, sf_dir, "labels"))
    folded = docs.select("doc_id", (toxicity.fold() == 2).alias("held_out"), "text")
    return toxicity.score_texts(folded, field, keep=("doc_id", "held_out"))
