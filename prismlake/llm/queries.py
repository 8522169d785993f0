"""One query per text operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, editcount, htmlwrap, neardup, quality, suffixdedup, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.without_repeats(table(spark, sf_dir, "documents"))



def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Other words that a proximity match may have in between.
SLOP = 2


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data is redacted."""
    docs = table(spark, sf_dir, "documents")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return editcount.edited_counts(docs, editcount.redactions(docs), ranks, public_tokenizers.PATTERN)


#: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_minhash_neardup, op3_toxicity_chain, op4_suffix_dedup, op5_html_wrappers, op6_quality_fm,
        op7_anisotropic_ann, op8_decontamination, op9_edit_counts, op10_url_rules,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op10_url_rules": f"""
        WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
        fits AS (SELECT DISTINCT host, path, h || p AS rule, verdict FROM (SELECT DISTINCT host, path FROM split) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
        best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY host, path)
        SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN best USING (host, path)""",
    "op7_anisotropic_ann": """
        WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
                      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
