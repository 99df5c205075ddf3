"""Operator 7, quality rules: document rules, and verdicts on hosts from shrunken failure rates.

Built-in functions only. Windows of words are told apart by 64-bit hashes first and, where hashes are equal, by their
words. The rules look at one text each, so they need no shuffle. A host (the
``source`` column) is then judged by its rate of failing documents: hosts' counts are summed, a beta
prior is fitted to the hosts' rates by moments, and each rate is drawn towards the prior's mean, so
that a host with a few documents can't be condemned by them. The verdict is joined back.

Defined cases: a null or empty text has no words and fails; documents without a source (null) belong
to no host and are judged by themselves; repeated rows count and return as often as they come; an
empty table gives an empty result; other columns, whatever their names, are ignored or carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import SPACES, materialize, numbered, table, words

MIN_WORDS = 50  # fewer words fail
MAX_REPEAT = 50  # per cent of words in repeated 3-word windows
MAX_HOST_RATE = 0.5  # a host whose shrunken failure rate is above goes
PRIOR_DOCS = 10.0  # strength of the prior where the hosts' rates don't differ
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column) -> Column:
    """Hashes of a text's 3-word windows, from the array of words."""
    return F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column, w: Column) -> Column:
    """Words that repeated windows cover.

    Sorted by hash, windows that may be equal are neighbours; of those the words are looked at, and sorted by hash and
    words, equal windows are neighbours.
    """

    def neighbours(s: Column, *fields: str) -> Column:
        def same(x: Column, y: Column) -> Column:
            alike = x[fields[0]] == y[fields[0]]
            for f in fields[1:]:
                alike = alike & (x[f] == y[f])
            return alike

        return F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))

    def once(x: Column, f) -> Column:  # f of x, which is computed once
        return F.element_at(F.transform(F.array(x), f), 1)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    maybe = once(placed, lambda s: neighbours(s, "h"))
    spelt = F.sort_array(F.transform(maybe, lambda x: F.struct(x["h"], F.get(w, x["i"]).alias("a"), F.get(w, x["i"] + 1).alias("b"), F.get(w, x["i"] + 2).alias("c"), x["i"])))
    at = F.sort_array(F.transform(once(spelt, lambda s: neighbours(s, "h", "a", "b", "c")), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        at,
        zero,
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )


def measures(docs: DataFrame) -> DataFrame:
    """(doc, w, ...): each input row whole as struct ``doc``, and the measures of its text beside it."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return (
        docs.select(F.struct("*").alias("doc"))
        .withColumn("w", words(F.col("doc.text")))
        .withColumn("windows", _repeat_words(F.col("w")))
        .withColumn("lines", lines)
        .select(
            "doc",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows"), F.col("w"))).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    )


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_ok) from rows with host and base_failed."""
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    # one row: the hosts' mean and variance, each host counting as one
    k, mean, var = hosts.agg(F.count("*"), F.avg(p), F.var_samp(p)).first()
    a, b = beta_prior(k, mean, var)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= max_rate)


def beta_prior(k: int, mean: float | None, var: float | None) -> tuple[float, float]:
    """Beta parameters by moments; with no spread to see, PRIOR_DOCS documents at the mean."""
    if not k:
        return 1.0, 1.0
    strength = PRIOR_DOCS
    if var and 0 < mean < 1:
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, measures, base_failed, rate, kept) for every row of docs.

    The measured rows, without texts, are written to the shared folder once: both the hosts' counts and the
    result read them.
    """
    measured = measures(docs.select("doc_id", "text", "source"))
    measured = materialize(measured.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("host"), *MEASURES, "base_failed"), "quality")
    return _judged(measured, verdicts_of(measured, max_rate))


def verdicts_of(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Host verdicts as a small table, whose size Spark knows when it plans the join."""
    return materialize(host_verdicts(measured, max_rate).select("host", "rate", "host_ok"), "hosts")


def _judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    # one expression on both sides of the join: a filter on it isn't pushed below, where the measures would be
    # written out again inside it
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce("host_ok", F.lit(True)))
    return measured.join(verdicts, "host", "left").withColumn("kept", kept)


def op7_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that the rules reject go, in the cases defined above.

    The rules run once: row names and verdicts are written, and the rows kept are joined back to the documents.
    """
    kept = numbered(docs)
    measured = measures(kept.select("rid", F.col("doc.text").alias("text"), F.col("doc.source").alias("source")))
    measured = materialize(measured.select("doc.rid", F.col("doc.source").alias("host"), "base_failed"), "failures")
    good = _judged(measured, verdicts_of(measured)).where("kept").select("rid")
    return kept.join(good.hint("merge"), "rid", "left_semi").select("doc.*")  # as many rows as documents: never broadcast


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM ln WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, d.source, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN dl USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT avg(f / n) AS mean, var_samp(f / n) AS v FROM h),
pr AS (SELECT mean, CASE WHEN v > 0 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1000.0) ELSE {PRIOR_DOCS} END AS s FROM mo),
ok AS (SELECT source, (f + mean * s) / (n + s) <= {MAX_HOST_RATE} AS ok FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN ok USING (source)
"""
