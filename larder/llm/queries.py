"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, hmm_lm, merge_dropout, ngram_join, periodic_runs, quality_rules, quotation, secret_scan, sharding, spelling, sql, token_orc, toxicity, vector_packing
from larder.llm.common import documents, fold, new_path
from larder.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, twin: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if twin is not None:
            ORACLE[name] = twin
        return fn
    return add


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), toxicity.toxicity_score(F.col("text"), net).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@query("op2_token_orc")
def op2_token_orc(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_orc.write_tokens(documents(spark, sf_dir), path, WORDS, end_id=2)
    return token_orc.token_digest(spark, path)


@query("op3_hmm_lm")
def op3_hmm_lm(spark, sf_dir):
    return hmm_lm.score_documents(documents(spark, sf_dir))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    c = F.col
    d = documents(spark, sf_dir).select("doc_id", secret_scan.find_secrets(c("text"), WORDS).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return d.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.span_list(base).cast("binary"), 256).alias("base_sha256"),
                    secret_scan.span_list(c("found")).alias("spans"), count("guess"))


@query("op5_decontaminate")
def op5_decontaminate(spark, sf_dir):
    return decontaminate.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op6_ngram_join", sql.NGRAM_JOIN)
def op6_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


@query("op7_host_quality", sql.HOST_QUALITY)
def op7_host_quality(spark, sf_dir):
    return quality_rules.quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", F.round("host_rate", 6).alias("host_rate"), "host_rejected")


@query("op8_quotation", sql.QUOTATION)
def op8_quotation(spark, sf_dir):
    return quotation.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op9_minimax_shards")
def op9_minimax_shards(spark, sf_dir):
    return (sharding.shard_documents(documents(spark, sf_dir), 24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "group_first"))


@query("op10_merge_dropout")
def op10_merge_dropout(spark, sf_dir):
    return merge_dropout.ids_digest(merge_dropout.dropout_ids(documents(spark, sf_dir), PIECES, key=1, dropout=0.1))


def repeated_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; those of one document in ten go round in a period from some word on."""
    words = text.split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


@query("op11_periodic_runs", sql.PERIODIC_RUNS)
def op11_periodic_runs(spark, sf_dir):
    c = F.col
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    d = periodic_runs.periodic_runs(documents(spark, sf_dir), repeated_words)
    # Runs come by start and period, so the first of the greatest exponents is the one asked for.
    runs = F.transform("runs", lambda r: F.struct(*(r[k].cast("long").alias(k) for k in ("start", "length", "period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = d.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
                 F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
                 F.when(F.size("runs") > 0, F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(more(r, best), r).otherwise(best))).alias("best"))
    return d.select("doc_id", "n_runs", c("best.start").alias("start"), c("best.length").alias("length"), c("best.period").alias("period"),
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


@query("op12_vector_packing")
def op12_vector_packing(spark, sf_dir):
    return (vector_packing.pack_documents(documents(spark, sf_dir), WORDS, tokens=2048, end_id=0)
            .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"))


def dropped_letters(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The word of a run in a document: one run in 97 loses a letter."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)

    def word(run: bytes) -> bytes:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % 97:
            return run
        i = h % len(run)
        return run[:i] + run[i + 1:]
    return word


@query("op13_spelling", sql.SPELLING)
def op13_spelling(spark, sf_dir):
    return spelling.spelling_groups(spelling.vocabulary(documents(spark, sf_dir), dropped_letters, shortest=5, fewest=3))
