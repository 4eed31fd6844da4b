"""Check queries: each operator over its whole table with production parameters, and the SQL of those SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import bpe, centroids, decontaminate, exact_dedup, filter_audit, hnsw, jaccard, license_scan, lmscore, quality, secret_scan, suffix, warc
from lakejobs.llm.tables import bounded_batches
from lakejobs.plans.registry import table
from lakejobs.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer, which every worker has; LAKEJOBS_TOKENIZERS names another folder."""
    folder = os.environ.get("LAKEJOBS_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(values) -> F.Column:
    return F.sha2(F.array_join(values, ",").cast("binary"), 256)


@_query()
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else f"/{folder.removeprefix('file:/').lstrip('/')}"
    warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    records = warc.resolved(warc.read_bundles(spark, folder, with_payload=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


@_query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()
    return bpe.encode_and_decode(docs, path, bpe.corpus_lexicon(docs, path)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query()
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lmscore.score_held_out(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "micros", F.round(F.col("micros") / lmscore.MICRO / F.greatest("n_words", F.lit(1)), 6).alias("mean_log_score"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query(OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = decontaminate.hit_words(F.col("spans")).cast("bigint")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        _joined("item_ids").alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


@_query()
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)"""


@_query(OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@_query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", F.col("_accepted").alias("kept"), F.round("_p_good", 4).alias("p_good"), F.round("_p_toxic", 4).alias("p_toxic"),
        F.round("_site", 4).alias("site"), F.round("_posterior", 4).alias("posterior"),
    )


@_query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@_query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", "part", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


@_query()
def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT m.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN m.doc_id > min(m.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM m LEFT JOIN marks ON marks.doc_id = m.doc_id),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
each AS (SELECT part, filter_order, step, letter, n, n_good, n_toxic, length(fails) AS n_fails,
           translate(fails, before, '') <> fails AS gone, contains(fails, letter) AS fail
         FROM masks, (SELECT filter_order, step, substr(filter_order, CAST(step AS INTEGER), 1) AS letter,
                        substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS before FROM steps)),
sums AS (SELECT part, filter_order, step, letter,
           CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN NOT gone AND fail THEN n_good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND fail THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost
         FROM each GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums"""


@_query(OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_sql(rounds: int = 3) -> str:
    """The rounds one after the other, over rows (vector, dimension, value)."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS (SELECT r, cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{i} c USING (d) GROUP BY r, cluster),
a{i} AS (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY cluster, d),
c{i + 1} AS (SELECT c.cluster, c.d, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
       FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.d = c.d)""")
    chain = ",\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT r, vec_id, unnest(range(1, 65)) AS d, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM k),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1 AS cluster FROM k),
c0 AS (SELECT cluster, d, x FROM v JOIN first USING (r) WHERE cluster < 16),
{chain},
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster),
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM sums) AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN k USING (r) JOIN sums ON sums.cluster = a.cluster JOIN digests ON digests.cluster = a.cluster"""


@_query(_op13_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.centroid_clusters(table(spark, sf_dir, "embeddings")))
