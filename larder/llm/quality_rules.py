"""Host-level quality rules, in DataFrame functions only.

Per document: word and symbol counts, repeated lines, words in repeated 5-word windows,
and the base rule (too few words, or over 20 % of the words repeated). Per host: how many
of its documents fail, shrunk towards the rate of all hosts by a beta prior whose two
parameters come from the mean and variance of the host rates (moments, weighted by
documents). A host is rejected if its rate is credibly worse than that of all hosts: the
posterior's mean less ``SURE`` standard deviations exceeds ``WORSE`` times the pooled rate.
So a small host needs more evidence than a large one, and a difference that is sure but slight
rejects none. Documents of a rejected host that fail a soft rule go too; its clean documents stay.

Defined results: a null text has no words (base rule fails); a null host is a host of its
own; repeated rows count as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import saved

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SPAN = 5
SURE, WORSE = 3.0, 1.5


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    c = F.col
    d = docs.select("doc_id", c(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "host",
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        _without(c("text"), SPACES).alias("word_chars"),
        (F.char_length("text") - _without(c("text"), SYMBOLS)).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "host", F.size("words").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= SPAN, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (SPAN - 1), F.lit(1))),
                                                    lambda i: F.xxhash64(F.slice("words", i, SPAN))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    d = d.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    d = d.withColumn("windows", F.when(c("twice"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(c("windows"), i)["h"]
    d = d.withColumn("places", F.array_sort(F.transform(F.filter("windows", lambda e, i: F.coalesce(at(i - 1) == e["h"], F.lit(False)) | F.coalesce(at(i + 1) == e["h"], F.lit(False))), lambda e: e["i"])))
    covered = F.aggregate("places", F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(SPAN))).alias("n")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return d.select("doc_id", "host", *(c(x).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    ((c("n_words") < 10) | (100 * c("n_repeat_words").cast("long") > 20 * c("n_words").cast("long"))).alias("base_failed"))


def soft_failed() -> Column:
    """Rules that only count in a rejected host: many symbols, repeated lines or repeated words."""
    c = F.col
    return (20 * c("n_symbols") > c("word_chars")) | (c("n_dup_lines") >= 3) | (100 * c("n_repeat_words") > 10 * c("n_words"))


def host_verdicts(rules: DataFrame, sure: float = SURE, worse: float = WORSE) -> DataFrame:
    """host, host_documents, host_failed, host_rate (shrunk), host_rate_low (its credible bound), host_rejected."""
    c = F.col
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"), F.sum(c("base_failed").cast("long")).alias("host_failed"))
    rate = c("host_failed") / c("host_documents")
    m = hosts.agg(F.sum("host_documents").alias("n"), F.sum("host_failed").alias("f"), F.count(F.lit(1)).alias("k"),
                  F.sum(c("host_documents") * rate * rate).alias("s2"))
    mean, var = c("f") / c("n"), F.greatest(c("s2") / c("n") - F.pow(c("f") / c("n"), F.lit(2)), F.lit(0.0))
    # Moments of a beta: a + b = mean (1 - mean) / var - 1. Without spread between hosts the prior weighs most.
    weight = F.when(var > 1e-9, F.least(F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = m.select(mean.alias("mean"), weight.alias("weight"))
    shrunk = (c("host_failed") + c("mean") * c("weight")) / (c("host_documents") + c("weight"))
    spread = F.sqrt(c("host_rate") * (1 - c("host_rate")) / (c("host_documents") + c("weight") + 1))
    return (hosts.join(F.broadcast(prior))  # one row
            .withColumn("host_rate", shrunk).withColumn("host_rate_low", c("host_rate") - sure * spread)
            .select("host", "host_documents", "host_failed", "host_rate", "host_rate_low", (c("host_rate_low") > worse * c("mean")).alias("host_rejected")))


def quality_verdicts(docs: DataFrame, host: str = "source", sure: float = SURE, worse: float = WORSE) -> DataFrame:
    """Rules of each document with its host's verdict and ``kept``.

    The rules are computed once and written (a few numbers a document); the hosts are
    aggregated from that table and joined back to it, without the texts.
    """
    rules = saved(document_rules(docs, host), "quality")
    v = host_verdicts(rules, sure, worse).withColumnRenamed("host", "h")
    d = rules.join(v, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return d.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & soft_failed()))
