"""One query per operator of this subpackage, with production parameters and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, centroids, language, phrases, pieces, secrets, simhash, warc
from tidemark.llm import toxicity as tox
from tidemark.llm.common import fold
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.pii import KINDS, personal_data
from tidemark.sources.tables import table

UP_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.detect(docs, language.fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, recall=0.95)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secrets.scan(docs, secrets.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(F.concat_ws(",", F.transform(base, _place)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", _place)).alias("spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


HEX_DIGIT = "(instr('0123456789abcdef', substr(h, CAST((5 * i) // 4 AS INTEGER) + {k}, 1)) - 1)"
OP7_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT DISTINCT h FROM p),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((({HEX_DIGIT.format(k=1)} * 16 + {HEX_DIGIT.format(k=2)}) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS digest
  FROM (SELECT h, unnest(range(32)) AS i FROM d) GROUP BY h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN b USING (h)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tox.toxicity(docs, tox.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms", "misspelled", "quoted")


def _place(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"], span["stop"])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.concat_ws(",", F.transform(base, _place)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", _place)).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UP_LOW}) AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP_LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UP_LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, widths WHERE len(w) >= n)),
m AS (SELECT doc_id, s, d.n, item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """One assignment and one move a round, written out."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INT) AS c, v FROM kept QUALIFY c < {k}),
parts AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept)"""]
    assigned = """
a{t} AS MATERIALIZED (
  SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT id, c, CAST(list_sum(list_transform(list_zip(kept.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM kept, c{t} AS m) GROUP BY id)"""
    for t in range(rounds):
        steps.append(assigned.format(t=t))
        steps.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c, coalesce(new.v, old.v) AS v FROM c{t} AS old LEFT JOIN (
    SELECT c, list({floor_mean} ORDER BY i) AS v
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN parts USING (id) GROUP BY c, i) GROUP BY c) AS new USING (c))""")
    steps.append(assigned.format(t=rounds))
    return ",".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (id) JOIN c{rounds} AS m USING (c)"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


OP12_SQL = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), {UP_LOW}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, w[s:s + m - 1] AS p FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM pieces, (VALUES (1), (2), (3)) AS lengths(m))),
f AS MATERIALIZED (SELECT lang, m, p, count(*) AS a FROM grams GROUP BY ALL HAVING m = 1 OR count(*) >= 10),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.m, c.p, c.a, k, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) AS c
  JOIN f AS l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f AS r ON r.lang = c.lang AND r.p = c.p[c.k + 1:c.m]),
covered AS (
  SELECT DISTINCT c.lang, c.p FROM f AS c JOIN (
    SELECT lang, a, unnest([p[1:2], p[2:3]]) AS part FROM f WHERE m = 3) AS t
  ON t.lang = c.lang AND t.part = c.p AND 100 * t.a >= 50 * c.a),
best AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score
  FROM cuts ANTI JOIN covered USING (lang, p) GROUP BY lang, p)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INT) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), repeatable=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_language": op2_language,
    "op3_ann": op3_ann,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_personal_data": op10_personal_data,
    "op11_centroids": op11_centroids,
    "op12_phrases": op12_phrases,
    "op13_pieces": op13_pieces,
}
ORACLE = {"op5_line_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_warc": OP7_SQL, "op11_centroids": _op11_sql(), "op12_phrases": OP12_SQL}
