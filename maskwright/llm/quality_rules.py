"""Quality rules: a threshold table compiled into one projection of built-in functions.

``measures`` adds the counts the rules speak of; ``judge`` turns a table of
``(rule, numerator, denominator, low, high)`` into one boolean column. A rule holds if
``low * denominator <= numerator <= high * denominator``; a missing bound does not bind.
Nothing is shuffled and no user function runs.

Words repeated in windows are found on hashes of three words: texts without a repeated
hash, the usual case, are done after one distinct count, others sort (hash, place) pairs.

Defined cases: a null text counts as an empty one; an empty text has zero counts and
fails the base rule; a rule with a null bound is open on that side; extra columns pass
through, and one named like a measure is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words, by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he at are this or his from an they which you "
          "one we all her had she there their been has have were who will no if out so what up",
    "de": "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
          "sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux "
          "ou cette mais comme on tout nous sa fait été aussi leur bien peut ces deux si elle",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque "
          "esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante",
}

#: (rule, numerator, denominator, low, high)
RULES: list[tuple[str, str, str, float | None, float | None]] = [
    ("length", "n_words", "1", 50, 200_000),
    ("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.05, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.3),
    ("words_per_line", "n_words", "n_lines", 2.0, None),
]

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
]


def stop_words() -> list[str]:
    found = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    return sorted({*found, *(w[0].upper() + w[1:] for w in found)})


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the long columns of ``MEASURES``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    step = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    step = step.select(
        *kept, "__text",
        F.filter(F.split("__text", SPACE + "+"), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    step = step.select(
        *kept, "__text", "__words", "__lines",
        F.expr(
            "if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3),"
            " i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"
        ).alias("__grams"),
    )
    step = step.select(
        *kept, "__text", "__words", "__lines",
        F.expr(
            "if(size(__grams) > size(array_distinct(__grams)),"
            " array_sort(transform(__grams, (g, i) -> named_struct('g', g, 'i', i))), null)"
        ).alias("__sorted"),
    )
    step = step.select(
        *kept, "__text", "__words", "__lines",
        F.expr(
            "if(__sorted is null, null, array_sort(transform(filter(__sorted, (x, k) ->"
            " (k > 0 and __sorted[k - 1].g = x.g) or (k + 1 < size(__sorted) and __sorted[k + 1].g = x.g)),"
            " x -> x.i)))"
        ).alias("__places"),
    )
    counts = {
        "n_words": "size(__words)",
        "word_chars": "length(array_join(__words, ''))",
        "n_symbols": f"length(__text) - length(regexp_replace(__text, '{SYMBOLS}', ''))",
        "n_lines": "size(__lines)",
        "n_dup_lines": "size(__lines) - size(array_distinct(__lines))",
        "n_repeat_words": "if(__places is null, 0, aggregate(__places, named_struct('upto', 0, 'n', 0), (a, p) ->"
        " named_struct('upto', p + 3, 'n', a.n + 3 - greatest(a.upto - p, 0)), a -> a.n))",
        "n_stop_words": f"size(filter(__words, w -> w in ({_quoted(stop_words())})))",
    }
    return step.select(*kept, *(F.expr(counts[m]).cast("long").alias(m) for m in MEASURES))


def verdict(rules=None) -> str:
    """The rule table as one SQL condition over the measures."""
    parts = []
    for _, numerator, denominator, low, high in RULES if rules is None else rules:
        if low is not None:
            parts.append(f"{numerator} >= {float(low)!r}D * {denominator}")
        if high is not None:
            parts.append(f"{numerator} <= {float(high)!r}D * {denominator}")
    return " AND ".join(f"({p})" for p in parts) or "true"


BASE_FAILED = f"(n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words)"


def judge(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    counted = measures(docs.drop("base_failed", "kept"), text)
    return counted.select(
        "*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(f"NOT {BASE_FAILED} AND {verdict(rules)}").alias("kept")
    )


def oracle() -> str:
    """The report in DuckDB's SQL, worked out from unnested words and windows."""
    words = r"[^\x20\x09-\x0D]+"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{words}') AS words FROM documents
),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{words}')) AS lines,
    len(list_filter(words, lambda w: w IN ({_quoted(stop_words())}))) AS n_stop_words
  FROM base
),
grams AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)
),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id
),
measured AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_stop_words
  FROM counted c LEFT JOIN covered v ON v.doc_id = c.doc_id
)
SELECT doc_id, {", ".join(f"{m}::BIGINT AS {m}" for m in MEASURES)},
  {BASE_FAILED} AS base_failed, NOT {BASE_FAILED} AND {verdict().replace("D *", "::DOUBLE *")} AS kept
FROM measured
"""
