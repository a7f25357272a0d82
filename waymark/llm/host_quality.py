"""Quality rules with verdicts by host: rule failures are summed by host, their rates are shrunk by an empirical beta
prior, and the rules that a host fails too often are enforced on its documents. DataFrame functions only.

The host of a document is its source. A document that fails no rule is always kept; one that fails a rule is rejected
if the rule is a base rule, or if the shrunk rate of its host for that rule is over HOST_RATE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import read_table, written

#: Characters between words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
#: A host whose shrunk failure rate for a rule is over this has the rule enforced.
HOST_RATE = 0.3
#: Strength of the prior where the hosts' rates don't vary.
FLAT_PRIOR = 10.0
RULES = ("symbols", "dup_lines", "word_length", "repeats")
#: Names of working columns begin so; a caller's columns hardly do.
OWN = "__waymark_"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more in the array."""

    def covered(ordered: Column) -> Column:  # (hash, start) of each window, sorted
        same = lambda x, k, j: F.coalesce(F.get(ordered, k + j)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: same(x, k, -1) | same(x, k, 1))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    def hashed(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        with_starts = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_let(with_starts(h), covered)))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(_let(words, hashed))


def with_metrics(docs: DataFrame) -> DataFrame:
    """docs with the working columns of the rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(BLANKS))
    rows = docs.withColumns({OWN + "host": F.coalesce(F.col("source").cast("string"), F.lit("")), OWN + "text": text})
    rows = rows.withColumn(OWN + "words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1)))
    rows = rows.withColumn(OWN + "lines", F.filter(F.split(F.col(OWN + "text"), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    words, lines, whole = F.col(OWN + "words"), F.col(OWN + "lines"), F.col(OWN + "text")
    rows = rows.withColumns(
        {
            OWN + "n_words": F.size(words).cast("bigint"),
            OWN + "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
            OWN + "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("bigint"),
            OWN + "n_lines": F.size(lines).cast("bigint"),
            OWN + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            OWN + "n_repeat_words": _repeated(words),
        }
    ).drop(OWN + "words", OWN + "lines", OWN + "text")
    n = {x: F.col(OWN + x) for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    return rows.withColumns(
        {
            OWN + "base_failed": (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > 50 * n["n_words"]),
            OWN + "fails_symbols": 10 * n["n_symbols"] > n["n_words"],
            OWN + "fails_dup_lines": 10 * n["n_dup_lines"] > 3 * n["n_lines"],
            OWN + "fails_word_length": (n["word_chars"] < 3 * n["n_words"]) | (n["word_chars"] > 12 * n["n_words"]),
            OWN + "fails_repeats": 100 * n["n_repeat_words"] > 30 * n["n_words"],
        }
    )


def host_verdicts(rows: DataFrame) -> DataFrame:
    """For each host: its documents, and for each rule its failures, the shrunk rate and whether the rule is enforced.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates.
    """
    counts = written(
        rows.groupBy(F.col(OWN + "host").alias("host")).agg(F.count("*").alias("n_docs"), *(F.sum(F.col(OWN + "fails_" + r).cast("bigint")).alias("n_" + r) for r in RULES)), "hosts"
    )
    rate = lambda r: F.col("n_" + r) / F.col("n_docs")
    prior = counts.agg(*(x for r in RULES for x in (F.avg(rate(r)).alias("m_" + r), F.var_samp(rate(r)).alias("v_" + r)))).first()  # one row
    for r in RULES:
        m, v = prior["m_" + r] or 0.0, prior["v_" + r] or 0.0
        strength = m * (1 - m) / v - 1 if v > 1e-12 else FLAT_PRIOR
        strength = strength if strength > 0 else FLAT_PRIOR
        counts = counts.withColumn("rate_" + r, (F.col("n_" + r) + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
        counts = counts.withColumn("enforced_" + r, F.col("rate_" + r) > HOST_RATE)
    return counts


def _judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows with OWN + kept and OWN + host_rules, the rules that the host enforces and the row fails."""
    hosts = verdicts.select(F.col("host").alias(OWN + "host"), *(F.col("enforced_" + r).alias(OWN + "enforced_" + r) for r in RULES))
    joined = rows.join(hosts, OWN + "host", "left")
    hit = {r: F.coalesce(F.col(OWN + "enforced_" + r), F.lit(False)) & F.col(OWN + "fails_" + r) for r in RULES}
    return joined.withColumns(
        {
            OWN + "kept": ~F.col(OWN + "base_failed") & ~reduce(lambda a, b: a | b, hit.values()),
            OWN + "host_rules": F.concat_ws(",", *(F.when(x, F.lit(r)) for r, x in hit.items())),
        }
    )


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept and the host rules that reject it.

    A null text has no words and fails the base rules; a null source counts as the host ''. Repeated rows and null
    doc_ids each give a row; an empty table gives none. Only doc_id, text and source are read.
    """
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rules")
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source")
    rows = written(with_metrics(keys).drop("text", "source"), "quality")  # counts only: the texts are read once
    return _judged(rows, host_verdicts(rows)).select("doc_id", *(F.col(OWN + x).alias(x) for x in out))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    Null, empty and very short texts go; a null source is the host ''. Equal rows share their fate; an empty table stays
    empty. Rows and their counts are written once, which the hosts' rates and the filter read.
    """
    rows = written(with_metrics(docs), "quality")
    return _judged(rows, host_verdicts(rows)).filter(F.col(OWN + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    rates = ", ".join(f"avg(n_{r} / n_docs) AS m_{r}, coalesce(var_samp(n_{r} / n_docs), 0) AS v_{r}" for r in RULES)
    strength = ", ".join(f"m_{r}, CASE WHEN v_{r} > 1e-12 AND m_{r} * (1 - m_{r}) / v_{r} - 1 > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {FLAT_PRIOR} END AS s_{r}" for r in RULES)
    enforced = ", ".join(f"(n_{r} + m_{r} * s_{r}) / (n_docs + s_{r}) > {HOST_RATE} AS e_{r}" for r in RULES)
    hit = " OR ".join(f"(e_{r} AND fails_{r})" for r in RULES)
    names = ", ".join(f"CASE WHEN e_{r} AND fails_{r} THEN '{r}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, sum(least(3, nx - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 3) AS nx FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS fails_symbols,
  10 * n_dup_lines > 3 * n_lines AS fails_dup_lines, word_chars < 3 * n_words OR word_chars > 12 * n_words AS fails_word_length,
  100 * n_repeat_words > 30 * n_words AS fails_repeats FROM m),
h AS (SELECT host, count(*) AS n_docs, {", ".join(f"sum(fails_{r}::INT)::DOUBLE AS n_{r}" for r in RULES)} FROM f GROUP BY host),
p AS (SELECT {strength} FROM (SELECT {rates} FROM h)),
v AS (SELECT host, {enforced} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hit}) AS kept,
  concat_ws(',', {names}) AS host_rules FROM f JOIN v USING (host)"""


QUERIES = {"op7_host_quality": op7_host_quality}
ORACLE_SQL = {"op7_host_quality": _sql()}
