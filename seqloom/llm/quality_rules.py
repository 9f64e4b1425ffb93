"""Rule-based quality verdicts as one Spark projection.

Every metric is a built-in expression over the row's own text, so a plan is scan -> project with no
shuffle and no Python. Repeated three-word windows are found inside the row: 64-bit window hashes are
truncated just enough to hold the window's position in the low bits, sorted as primitive longs, and
equal neighbours name the positions that may be repeated. The words of these positions are then sorted and
compared themselves, so the count is exact whatever the hashes are.

Defined results: null or empty text has zero in every metric and fails the base rule; repeated rows
get the same verdict each; an empty table gives an empty result; input columns that bear a result's name, in any case, are replaced by
the result, others may have any name and are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, apart, column, others

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with they be at this have from or by an not "
    "der die und zu den das von ist des sich mit dem er es ein ich auf so eine auch als an nach wie im für "
    "le la les de des du un une et est que qui dans pour pas sur au avec ce il "
    "el la los las de que y en un por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are SQL expressions over the measured columns.
RULES = (
    Rule("mean word length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols per word", "n_symbols / n_words", None, 0.1),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    Rule("stop words", "n_stop_words / n_words", 0.02, None),
)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "n_distinct_words")


def measured(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """``docs`` plus METRICS; input columns of these names are replaced."""
    own = apart(docs)
    words, lines = own + "words", own + "lines"
    names = [column(c) for c in others(docs, *METRICS)]
    value = F.coalesce(column(text), F.lit(""))
    has_word = f"[^{SPACE_CLASS[1:]}"
    base = docs.select(
        *names,
        F.array_remove(F.split(value, SPACE_CLASS + "+"), "").alias(words),
        F.filter(F.split(value, "\n"), lambda line: line.rlike(has_word)).alias(lines),
        F.size(F.regexp_extract_all(value, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
    ).select(
        *names,
        words,
        "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return _with_repeats(base, own, hash_bits).select(
        *names,
        "n_words",
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_lines",
        "n_repeat_words",
        F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
    )


def _with_repeats(base: DataFrame, own: str, hash_bits: int) -> DataFrame:
    """Add n_repeat_words: how many words lie in a three-word window found at least twice.

    The steps are separate projections, so that sorting and zipping stay in generated code and the
    lambdas hold a few operations each. ``hash_bits`` changes the work, never the result; ``own`` begins the names of the steps.
    """
    words, size = F.col(own + "words"), F.size(own + "words")
    low, high, keys, twice, likely, read, same, starts = (F.col(own + x) for x in ("low", "high", "keys", "twice", "likely", "read", "same", "starts"))

    def step(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.withColumn(own + name, value)

    def neighbours(values: Column) -> Column:
        pairs = F.greatest(F.size(values) - 1, F.lit(0))
        return F.arrays_zip(F.slice(values, F.lit(1), pairs).alias("a"), F.slice(values, F.lit(2), pairs).alias("b"))

    long = lambda x: F.lit(x).cast("long")
    windows = F.arrays_zip(*(F.slice(words, F.lit(i), F.greatest(size - 2, F.lit(0))).alias(f"w{i}") for i in (1, 2, 3)))
    width = F.greatest(F.ceil(F.log2(size.cast("double"))).cast("int"), F.lit(1)) + 1
    df = step(base, "low", F.when(size > 0, F.call_function("shiftleft", long(1), width) - 1).otherwise(long(0)))
    df = step(df, "high", F.bitwise_not(low).bitwiseAND(long(-(1 << (64 - hash_bits)))))
    df = step(df, "keys", F.sort_array(F.transform(windows, lambda x, i: F.xxhash64(x).bitwiseAND(high).bitwiseOR(i.cast("long")))))
    # keys of one window differ in the position bits alone; those of other windows may meet them
    df = step(df, "twice", F.filter(neighbours(keys), lambda x: x["a"].bitwiseAND(high) == x["b"].bitwiseAND(high)))
    df = step(df, "likely", F.array_distinct(F.concat(F.transform(twice, lambda x: x["a"].bitwiseAND(low)), F.transform(twice, lambda x: x["b"].bitwiseAND(low)))))
    df = step(df, "read", F.sort_array(F.transform(likely, lambda p: F.struct(*(words[p + i].alias(f"w{i}") for i in range(3)), p.alias("at")))))
    df = step(df, "same", F.filter(neighbours(read), lambda x: (x["a"]["w0"] == x["b"]["w0"]) & (x["a"]["w1"] == x["b"]["w1"]) & (x["a"]["w2"] == x["b"]["w2"])))
    df = step(df, "starts", F.sort_array(F.array_distinct(F.concat(F.transform(same, lambda x: x["a"]["at"]), F.transform(same, lambda x: x["b"]["at"])))))
    later = F.slice(starts, F.lit(2), F.size(starts))
    gaps = F.transform(F.arrays_zip(starts.alias("a"), later.alias("b")), lambda x: F.least(F.coalesce(x["b"] - x["a"], long(3)), long(3)))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, long(0), lambda a, x: a + x))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        value = F.expr(rule.metric)
        for side in ([value >= rule.low] if rule.low is not None else []) + ([value <= rule.high] if rule.high is not None else []):
            out = out & F.coalesce(side, F.lit(False))
    return out


def verdicts(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` columns plus the metrics, ``base_failed`` and ``kept``."""
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured(docs, text).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & F.when(F.col("n_words") > 0, passes(rules)).otherwise(False))


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(docs).select(*QUERY_COLUMNS)


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    n AS (SELECT row_number() OVER () AS rid, * FROM w),
    g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM n WHERE len(words) >= 3),
    k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM g),
    p AS (SELECT rid, count(DISTINCT i + d) AS r FROM k, (VALUES (0), (1), (2)) o(d) WHERE c > 1 GROUP BY rid),
    m AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(lines)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM n LEFT JOIN p USING (rid)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {_sql_rules()} AS kept
    FROM b"""


def _sql_rules(rules: tuple[Rule, ...] = RULES) -> str:
    sides = [f"coalesce({r.metric} {op} {bound}, false)" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return "(n_words > 0 AND " + " AND ".join(sides) + ")"


SQL = _sql()
