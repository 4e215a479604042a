"""One query per operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.lineage import table
from maskwright.llm import byte_bpe, decontaminate, hard_negatives, importance, language_id, line_dedup, lm_scoring, paragraph_dedup, quality_model, quality_rules, simhash, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def default_tokenizer(spark: SparkSession):
    """The multilingual byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.tables(spark, path, public_tokenizers.PATTERN)


@query()
def op3_byte_bpe(spark, folder):
    held = default_tokenizer(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.round_trip(docs, held))


@query(lm_scoring.oracle())
def op1_lm_scoring(spark, folder):
    return lm_scoring.score(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op2_quality_model(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality_model.fit(docs, labels.where(~language_id.held_out()))
    scored = quality_model.score(docs, model).select("doc_id", "score", "predicted")
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


@query()
def op4_simhash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.report(simhash.components(simhash.fingerprints(docs)))


@query()
def op5_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return decontaminate.report(hits)


@query()
def op6_paragraph_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    least = paragraph_dedup.SHINGLE
    found = paragraph_dedup.repeats(docs, {paragraph_dedup.LINE: least, paragraph_dedup.PIECE: least})
    unit = F.when(F.col("unit") == paragraph_dedup.PIECE, "piece").otherwise("line").alias("unit")
    return found.select(unit, "doc_id", "line", "n_words", "keep_doc_id", "keep_line", "removed", "word", "keep_word")


@query(quality_rules.oracle())
def op7_quality_rules(spark, folder):
    judged = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


@query()
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op9_suffix_dedup(spark, folder):
    return suffix_dedup.report(suffix_dedup.drop_repeats(table(spark, folder, "documents").select("doc_id", "text")))


@query(f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents
),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (
  SELECT l.source, line FROM lines l JOIN totals t ON t.source IS NOT DISTINCT FROM l.source
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY l.source, line, host_pages
  HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_PAGES}
     AND count(DISTINCT doc_id) > host_pages * {line_dedup.MAX_RATIO}::DOUBLE
),
judged AS (
  SELECT doc_id, line, place,
         EXISTS (SELECT 1 FROM bad b WHERE b.line = l.line AND b.source IS NOT DISTINCT FROM l.source) AS gone
  FROM lines l
),
kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_dropped,
         string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY place) AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""")
def op10_line_dedup(spark, folder):
    return line_dedup.report(line_dedup.drop_boilerplate(table(spark, folder, "documents").select("doc_id", "text", "source")))


TOKEN_LIMIT = 2048


@query()
def op11_token_counts(spark, folder):
    import public_tokenizers

    held = token_counts.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_counts.budgets(docs, held, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_fit")


@query(importance.oracle())
def op12_importance_resampling(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, folder, "benchmark").select("text"))


@query(hard_negatives.oracle())
def op13_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"), relabel=label)
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)
