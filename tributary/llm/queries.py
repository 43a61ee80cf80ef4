"""The training-data operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.llm import (
    collocations, decontamination, langid, lines, mixing, neighbours, pii, search, secrets, sharding, simhash, tokens, toxicity,
)
from tributary.llm.common import prepare, table
from tributary.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(apply_settings(spark)), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixture = mixing.plan(docs, entropy=0.98, repetition=2.0)
    return mixing.mixed(docs, mixture).select("doc_id", "source", *mixing.ADDED)


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_law(table(spark, sf_dir, "documents"), shards=40)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_verdicts(table(spark, sf_dir, "documents"), max_bits=3, similarity=0.8)


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, benchmark, similarity=0.8).drop("row_key")


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_lexical_search",
    f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all({_LOWER}, '{_TERMS}') AS t FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(t) > 0) AS big_n, sum(len(t)) AS big_l FROM d
), occ AS (
  SELECT uid, doc_id, len(t) AS n, unnest(t) AS term FROM d WHERE len(t) > 0
), post AS (
  SELECT uid, doc_id, n, term, count(*) AS tf FROM occ GROUP BY uid, doc_id, n, term
), df AS (
  SELECT term, count(*) AS df FROM post GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark
  ) GROUP BY item_id, term
), scored AS (
  SELECT q.item_id, post.uid, post.doc_id,
         sum(q.qtf * CAST(floor(1000 * ln((2.0 * s.big_n + 2) / (2.0 * df.df + 1))) AS BIGINT)
             * ((1000000000 * post.tf) // (1000 * post.tf + 8 * (25 + (75 * post.n * s.big_n) // s.big_l)))) AS score
  FROM q JOIN post ON q.term = post.term JOIN df ON df.term = q.term, s
  GROUP BY q.item_id, post.uid, post.doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, uid) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search.search(docs, benchmark, k=10).drop("query_uid")


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"), parts=5)


_PIECE_SPLIT, _WORD = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"


@query(
    "op13_collocations",
    f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents
), p0 AS (
  SELECT lang, unnest(regexp_split_to_array(t, '{_PIECE_SPLIT}')) AS piece FROM d
), p AS (
  SELECT lang, regexp_extract_all(piece, '{_WORD}') AS w FROM p0
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), starts AS (
  SELECT lang, w, v.len, unnest(range(1, len(w) - v.len + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(len)
), f AS (
  SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL
), c AS (
  SELECT lang, phrase, len, f AS a FROM f WHERE len >= 2 AND f >= 30
), cuts AS (
  SELECT lang, phrase, len, a, unnest(range(1, len)) AS k FROM c
), sides AS (
  SELECT lang, phrase, a, k,
         array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
         array_to_string(string_split(phrase, ' ')[k + 1:len], ' ') AS rp
  FROM cuts
), scored AS (
  SELECT s.lang, s.phrase, s.a, s.k, fl.f AS l, fr.f AS r,
         CAST((CAST(s.a AS HUGEINT) * 2000000) // (fl.f + fr.f) AS BIGINT) AS score
  FROM sides s JOIN f fl ON fl.lang = s.lang AND fl.phrase = s.lp JOIN f fr ON fr.lang = s.lang AND fr.phrase = s.rp
), weakest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored
  ) WHERE o = 1
), sizes AS (
  SELECT lang, a, string_split(phrase, ' ') AS w, len, unnest(range(2, len)) AS size FROM c WHERE len > 2
), inner_runs AS (
  SELECT lang, a, w, size, unnest(range(1, len - size + 2)) AS s FROM sizes
), covering AS (
  SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_runs GROUP BY ALL
), kept AS (
  SELECT w.lang, w.phrase, w.a, w.l, w.r, w.score FROM weakest w
  LEFT JOIN covering v ON v.lang = w.lang AND v.phrase = w.phrase
  WHERE v.longer IS NULL OR v.longer * 100 < w.a * 80
), ranked AS (
  SELECT kept.*, totals.n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept JOIN totals USING (lang)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, n, score
FROM ranked WHERE rank <= 2000
""",
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), top=2000).drop("k")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
