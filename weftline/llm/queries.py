"""The thin queries of the corpus operators, and their SQL where SQL can express them.

Reading HTML, with all its character references, is beyond SQL: op3 is tested against
the parser of the standard library, and the rest of its columns by ``warc_source_links``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import with_copies

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs.drop("n_chars")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_documents, write_shards

    return read_documents(write_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(), end_id=2))


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op8_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_count import count_tokens

    counted = count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_hits, is_contaminated, n_hit

    found = benchmark_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derived_records, responses_from_pages

    return derived_records(responses_from_pages(_table(spark, sf_dir, "pages"))).withColumnRenamed("source_id", "page_id").drop("block", "http_headers")


def warc_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, links and digests of the derived records that take no reading of HTML, which SQL can give."""
    from .warc import derived_records, responses_from_pages

    found = derived_records(responses_from_pages(_table(spark, sf_dir, "pages")))
    return found.select(F.col("source_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_content_type", "source_length", "source_digest")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_components

    return join_components(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("dedup_text", F.lit("")), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2))
    scored = score_texts(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import greatest_run, periodic_runs, planted

    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs).withColumn("best", greatest_run(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op12_bm25_packing": op12_bm25_packing,
    "op13_hilbert_negatives": op13_hilbert_negatives,
    "op11_periodic_runs": op11_periodic_runs,
    "op7_ppm_scores": op7_ppm_scores,
    "op3_warc_derivatives": op3_warc_derivatives,
    "warc_source_links": warc_source_links,
    "op5_line_dedup": op5_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op1_wavelet_shards": op1_wavelet_shards,
    "op8_bpe_token_counts": op8_bpe_token_counts,
    "op9_benchmark_hits": op9_benchmark_hits,
    "op2_mix_sources": op2_mix_sources,
    "op10_quality_outliers": op10_quality_outliers,
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
lim AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM per),
lev AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + most)
    / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM lim),
tgt AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM lev),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM tgt)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), chr(31) || coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM bs),
ds AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM ds),
h AS (SELECT rid, s, n, item FROM dw JOIN bw USING (n, win)),
hp AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hp USING (rid) LEFT JOIN hi USING (rid)
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
al AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS x FROM d),
wl AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM al),
nl AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) AS line, sum(w) OVER (PARTITION BY rid ORDER BY pos) AS upto FROM wl WHERE w > 0),
xs AS (SELECT rid, list(x ORDER BY pos) AS lines FROM nl GROUP BY rid),
fw AS (SELECT s.rid, s.line AS a, min(e.line) AS b FROM nl s JOIN nl e ON s.rid = e.rid AND e.line BETWEEN s.line AND s.line + 49 AND e.upto >= s.upto - s.w + 50 GROUP BY ALL),
bw AS (SELECT e.rid, max(s.line) AS a, e.line AS b FROM nl e JOIN nl s ON s.rid = e.rid AND s.line BETWEEN e.line - 49 AND e.line AND e.upto >= s.upto - s.w + 50 GROUP BY ALL),
win AS (SELECT DISTINCT rid, a, b FROM (SELECT * FROM fw UNION ALL SELECT * FROM bw)),
c AS (SELECT win.rid, a, b, md5(array_to_string(lines[a:b], chr(10))) AS h, row_number() OVER (PARTITION BY md5(array_to_string(lines[a:b], chr(10))) ORDER BY win.rid, a) AS nth FROM win JOIN xs USING (rid)),
gone AS (SELECT DISTINCT rid, unnest(range(a, b + 1)) AS line FROM c WHERE nth > 1),
gp AS (SELECT rid, pos FROM gone JOIN nl USING (rid, line)),
kept AS (SELECT rid, string_agg(x, chr(10) ORDER BY pos) AS t FROM al WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.rid = al.rid AND gp.pos = al.pos) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM nl GROUP BY rid), g AS (SELECT rid, count(*) AS n FROM gp GROUP BY rid)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_deleted, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid) LEFT JOIN g USING (rid)
"""

OP13_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.other_id, s.br) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

WARC_SQL = r"""
WITH h AS (SELECT *, md5('response' || chr(31) || CAST(page_id AS VARCHAR) || chr(31) || coalesce(url, '')) AS r FROM pages),
i AS (SELECT *, '<urn:uuid:' || r[1:8] || '-' || r[9:12] || '-' || r[13:16] || '-' || r[17:20] || '-' || r[21:32] || '>' AS source FROM h),
k AS (SELECT *, unnest(['metadata', 'conversion']) AS kind FROM i),
m AS (SELECT *, md5(kind || chr(31) || source) AS d FROM k)
SELECT page_id, kind AS warc_type, '<urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] || '>' AS record_id, source AS refers_to, url AS target_uri,
  CASE kind WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain; charset=utf-8' END AS content_type, 'text/html; charset=utf-8' AS source_content_type,
  CAST(strlen(coalesce(html, '')) AS BIGINT) AS source_length, 'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM m
"""

ORACLES = {"warc_source_links": WARC_SQL, "op13_hilbert_negatives": OP13_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_line_dedup": OP5_SQL, "op9_benchmark_hits": OP9_SQL, "op2_mix_sources": OP2_SQL}
