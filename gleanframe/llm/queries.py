"""The registered queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import bpe, merkle, pii, secrets, toxicity
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .langid import languages
from .licenses import license_scan
from .negatives import hard_negatives
from .packing import pack
from .quality import judged
from .repeats import without_repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


@query()
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(documents(spark, folder), *paths, public_tokenizers.PATTERN)


@query()
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, folder), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op1_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return judged(documents(spark, folder)).drop("_sign")


@query()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(documents(spark, folder)).drop("blocks")


@query()
def op6_pii_field(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(documents(spark, folder))


@query()
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder)).drop("first")


@query()
def op5_secret_owners(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(documents(spark, folder))


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))




@query(r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda f: coalesce(octet_length(encode(f))::VARCHAR || ':' || f, '-')) AS f,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(array_to_string(f, '') || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(array_to_string(f, '') || coalesce(octet_length(encode(t))::VARCHAR || ':' || t, '-')) AS claimed
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN low ELSE text END AS t FROM d)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
lower(level, tree, pos, n, h) AS (
  SELECT 0, tree, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lower WHERE n > 1 GROUP BY level, tree, pos // 8, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, level AS height FROM lower WHERE n = 1),
upper(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT level, tree, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM lower WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM upper WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT p.tree, p.pos, r.level, r.hs, (p.pos // (8 ** r.level)::BIGINT) % 8 AS digit
  FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.pos // (8 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, s.height + r.level, r.hs, (s.pos // (8 ** r.level)::BIGINT) % 8
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN top_runs r ON r.run = s.pos // (8 ** (r.level + 1))::BIGINT),
sides AS (
  SELECT tree, pos, level, array_to_string(hs[1:digit], '') AS before, array_to_string(hs[digit + 2:], '') AS after FROM steps),
proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY level) AS proof FROM sides GROUP BY tree, pos),
folds(tree, pos, level, h) AS (
  SELECT tree, pos, 0, claimed FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN sides s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
ends AS (SELECT tree, pos, arg_max(h, level) AS folded_root FROM folds GROUP BY tree, pos),
whole AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, w.root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = w.root AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.pos = p.pos
LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos CROSS JOIN whole w""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    rows = merkle.verified(merkle.manifest(documents(spark, folder), changed={"text": tampered}))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(), 256).alias("proof_sha256"), "folded_root", "verified")


@query("""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 5""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return hard_negatives(vectors, F.col("id") % 100 == 0, label=label)


@query()
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(documents(spark, folder))
