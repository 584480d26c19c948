"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Each rule is a row (name, numerator, denominator, least, most) over counted columns; a text passes
when every numerator / denominator lies within its bounds.  All counting is done inside the row by
array functions, so there is no shuffle and a copy-heavy or skewed table costs nothing extra.

Nulls and empty texts have no words and fail; ties don't arise; repeated rows get equal verdicts;
extra columns are passed through untouched except where they bear a counted column's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this from or an at have not",
    "fr": "le la les de des et en un une du que qui dans pour par sur au est il elle ne pas ce",
    "de": "der die das und in zu den von mit ist sich des auf für nicht ein eine dem im als auch es",
    "es": "el la los las de que y en un una por con para del se no es al lo su como más",
}

#: name, numerator, denominator, least, most (None: unbounded)
RULES = [
    ("words", "n_words", None, 20, None),
    ("repeated_words", "100 * n_repeat_words", "n_words", None, 30),
    ("mean_word_length", "word_chars", "n_words", 2, 14),
    ("symbols", "100 * n_symbols", "n_words", None, 20),
    ("duplicate_lines", "100 * n_dup_lines", "n_lines", None, 40),
    ("stop_words", "100 * n_stop_words", "n_words", 2, None),
]


def _repeat_stages(df: DataFrame, words: str, k: int) -> DataFrame:
    """Adds n_repeat_words: words within k-word windows that occur twice or more in the text.

    Window hashes come from doubling (1, 2, 4, 8 words).  Only texts with a repeated hash go on to
    sort (hash, position) pairs, keep those equal to a neighbour, and add up the words they cover.
    """
    if k & (k - 1):
        raise ValueError("the window must be a power of two")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    span = 1
    while span < k:
        shifted = F.slice(F.col("_h"), span + 1, F.greatest(F.size("_h"), F.lit(1)))
        df = df.withColumn("_h", F.zip_with(F.col("_h"), shifted, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    df = df.withColumn("_h", F.slice(F.col("_h"), 1, F.greatest(F.size("_h") - (k - 1), F.lit(0))))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs)).drop("_h")
    twice = F.filter(
        F.col("_s"),
        lambda x, i: (x["h"] == F.get(F.col("_s"), i + 1)["h"])
        | (F.when(i > 0, x["h"] == F.get(F.col("_s"), F.greatest(i - 1, F.lit(0)))["h"])),
    )
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    gaps = F.transform(
        F.col("_p"), lambda p, i: F.least(F.lit(k), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(k)))
    )
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_p")


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """The counted columns beside the given ones; `text` itself is dropped."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACES), "")).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(stops))).cast("long"),
        }
    ).drop("_l", "_t")
    return _repeat_stages(df, "_w", WINDOW).drop("_w")


def verdict(rules: list[tuple] = RULES) -> Column:
    """One boolean expression of the whole threshold table."""
    passed = F.lit(True)
    for _, top, bottom, least, most in rules:
        scale = F.expr(bottom) if bottom else F.lit(1)
        if least is not None:
            passed = passed & (F.expr(top) >= least * scale)
        if most is not None:
            passed = passed & (F.expr(top) <= most * scale)
    return passed


def quality(df: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Counts and verdicts; base_failed follows the two fixed rules, kept also the rest of the table."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted(df, text).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    rules = []
    for _, top, bottom, least, most in RULES:
        scale = bottom or "1"
        rules += [f"{top} >= {least} * {scale}"] if least is not None else []
        rules += [f"{top} <= {most} * {scale}"] if most is not None else []
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p),
s AS (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS x FROM c WHERE n > 1),
z AS (SELECT r, sum(x)::BIGINT AS n_repeat_words FROM s GROUP BY r),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN z USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {" AND ".join(rules)} AS kept
FROM q
"""
