"""The corpus operators as queries over ``documents``, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, exact, fim, langid, lines, lm, media, mixing, ngram_join, packing, pieces, secrets, shards
from .common import documents, remainder, vocabulary_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")), "text", "lang")
    found = langid.predict(docs, model, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(documents(spark, sf_dir), "doc_id", "text")
    counts = [secrets.count(F.col("found"), k).alias(f"n_{k}") for k in secrets.BASE]
    base = secrets.spans(F.col("found"), secrets.BASE)
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spans(F.col("found")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_MATCHES = "\n  UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS rank, '{secrets.ROLES[k]}' AS part, regexp_extract_all(t, {_quoted(p)}, 0) AS ms, string_split_regex(t, {_quoted(p)}) AS gs FROM docs" for i, (k, p) in enumerate(secrets.KINDS.items()))

OP2_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_MATCHES}),
parts AS (SELECT doc_id, kind, rank, part, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM found WHERE len(ms) > 0),
placed AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM parts),
fit AS (SELECT doc_id, kind, rank, part, e - length(m) AS s, e FROM placed WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 2)) >= 6
    WHEN 'ident' THEN length(regexp_extract(m, {_quoted(secrets.IDENT)}, 2)) >= 3
    WHEN 'token' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
    ELSE true END),
near AS (SELECT p.doc_id, p.kind, p.s, p.e, list_distinct(list(q.part)) AS parts FROM fit p JOIN fit q ON p.doc_id = q.doc_id
    AND ((q.e <= p.s AND p.s - q.e <= {secrets.SCOPE}) OR (q.s >= p.e AND q.s - p.e <= {secrets.SCOPE})) GROUP BY ALL),
kept AS (SELECT f.*, f.kind || ':' || f.s || ':' || f.e AS span FROM fit f LEFT JOIN near n USING (doc_id, kind, s, e) WHERE CASE f.kind
    WHEN 'ident' THEN list_contains(n.parts, 's')
    WHEN 'token' THEN list_contains(n.parts, 'i') OR list_contains(n.parts, 'e')
    WHEN 'endpoint' THEN list_contains(n.parts, 'i') AND list_contains(n.parts, 's')
    ELSE true END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM docs d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_dedup(documents(spark, sf_dir), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
     g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(documents(spark, sf_dir), "doc_id", "text", num=80, den=100)
    removed = F.array_join(F.transform("removed", lambda x: x.cast("string")), ",")
    return rows.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), removed.alias("removed_lines"))


def op5_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.score_documents(documents(spark, sf_dir), "doc_id", "text", remainder(F.col("doc_id"), 7) == 2)
    return rows.withColumnRenamed("id", "doc_id")


def op6_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_rows(documents(spark, sf_dir), "doc_id", "text")
    feature = F.array_join(F.transform("fingerprint", lambda x: F.lower(F.hex(x))), ",")
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(documents(spark, sf_dir), "doc_id", "text", 24).withColumnRenamed("id", "doc_id")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.near_duplicates(documents(spark, sf_dir), "doc_id", "text", ngram_join.Rule(words=3, num=90, den=100))
    return rows.withColumnRenamed("id", "doc_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.round_trip(documents(spark, sf_dir), "doc_id", "text", vocabulary_path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), "doc_id", "text", vocabulary_path()).withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(documents(spark, sf_dir), "doc_id", "text"))
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select(F.col("id").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *hashes)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.align(documents(spark, sf_dir), "doc_id", "text", vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir), "doc_id", "text", "source")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP13_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, z, [5, 2, 1][1 + (k - 1) % 3] AS w FROM s),
-- with the sources that end at their cap first, the price of a weight is the first that the next source can bear
o AS (SELECT *, 3 * z / w AS ratio, row_number() OVER (ORDER BY 3 * z / w, source) AS r FROM w),
c AS (SELECT *, sum(z) OVER () - coalesce(sum(3 * z) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM o),
price AS (SELECT p, q FROM c WHERE w * p <= 3 * z * q ORDER BY r LIMIT 1),
t AS (SELECT source, z, CASE WHEN w * p > 3 * z * q THEN CAST(3 * z AS DOUBLE) ELSE CAST(w * p AS DOUBLE) / CAST(q AS DOUBLE) END AS target FROM w, price),
g AS (SELECT source, z, target, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS k FROM t),
m AS (SELECT d.*, g.z, g.target, g.k, g.target - g.k * g.z AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(z AS BIGINT) AS source_size, target,
    CAST(size * (k + CASE WHEN before < rest AND (before + size <= rest OR before + size - rest <= rest - before) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""


QUERIES = {"op1_language_id": op1_language_id, "op2_secret_scan": op2_secret_scan, "op3_exact_dedup": op3_exact_dedup, "op4_line_dedup": op4_line_dedup, "op5_interpolated_lm": op5_interpolated_lm, "op6_audio_columns": op6_audio_columns, "op7_jump_sharding": op7_jump_sharding, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_sentencepiece": op9_sentencepiece, "op10_best_fit_packing": op10_best_fit_packing, "op11_fill_in_middle": op11_fill_in_middle, "op12_tokenizer_alignment": op12_tokenizer_alignment, "op13_source_mixing": op13_source_mixing}

ORACLES = {"op2_secret_scan": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op11_fill_in_middle": OP11_SQL, "op13_source_mixing": OP13_SQL}
