"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (bitpack, bpe, chat, fingerprints, hmm, packing, periodic_runs, quality_rules, sharding,
                           simhash, toxicity, weak_classifier, whitening)
from tallyline.llm.common import WORD_GAP, documents, held_out, let
from tallyline.session import checkpoint_root
from tallyline.sources import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257
END_ID = 2
SHARDS = 40
COMPONENTS = 32


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as counts and digests."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern)
    both = bpe.decode(ids, ranks, pattern)
    return both.select("doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents interleaved over 40 shards in the proportions of their sources."""
    rows = documents(spark, sf_dir).select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.interleave(rows, "doc_id", "source", SHARDS, phased=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text under a hidden Markov model."""
    return hmm.score(documents(spark, sf_dir), ~held_out("doc_id", 7, 2))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that may be used."""
    docs = documents(spark, sf_dir)
    net = toxicity.fit(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")))
    scores = toxicity.score(docs, net)
    return scores.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document, its edited text and their likeness."""
    return fingerprints.next_document_likeness(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and weakly supervised verdict of every document."""
    return quality_rules.quality_report(documents(spark, sf_dir))


def op9_weak_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a scorer trained on weak labels."""
    return weak_classifier.classify(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to bit-packed token files and read back."""
    return bitpack.token_file_round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER),
                                         VOCABULARY, END_ID)


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, written as a
    prefix tree and read back."""
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                    "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    folder = os.path.join(checkpoint_root(spark), "chats", uuid.uuid4().hex)
    tokenizer = public_tokenizers.path(TOKENIZER)
    chat.write_chats(rows, folder, tokenizer)
    turns = chat.read_chats(spark, folder, tokenizer).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "role", "text", "learned", "written_chars"))).alias("turns"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["learned"], F.lit(""))), "")
    chars = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["written_chars"])
    return turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                        F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), chars.alias("formatted_chars"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every sound embedding."""
    vectors = whitening.quantise(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "x")
    rows, white, error = whitening.whiten(vectors.select("vec_id", "x"), "x", COMPONENTS)
    explained = F.array(*[F.lit(e) for e in white.explained]) if white else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"),
                       F.lit(white.n if white else 0).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(explained, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def repeated_tail(id_col: str, text_col: str) -> Column:
    """The text, for one id in ten with its words from some place on repeating those
    found there; a NULL id or text as it is."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(F.col(text_col), WORD_GAP), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        return let(g % n, lambda a: let(1 + F.call_function("div", n - a, 3 + g % 8), lambda p: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
                w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    edited = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, edited).otherwise(F.col(text_col))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periodic runs of every document, and its text without their repeats."""
    docs = documents(spark, sf_dir).select("doc_id", repeated_tail("doc_id", "text").alias("text"))
    found = periodic_runs.with_runs(docs).select("doc_id", "runs", "collapsed")
    # the larger of two fractions by cross products; of equal ones the first stays
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    most = F.aggregate("runs", nothing, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), most.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.call_function("div", F.lit(1000) * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, toxicity, near-duplicates and packing, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_byte_bpe, op2_stratified_shards, op3_hmm_scores, op4_vector_packing, op5_toxicity, op6_simhash,
        op7_chunk_fingerprints, op8_quality_rules, op9_weak_classifier, op10_token_files, op11_chat_tree,
        op12_whitening, op13_periodic_runs, pipeline)
}

#: No query here is plain SQL: models trained by iteration, tokenizer libraries,
#: XXH64 and CRC-32 have no DuckDB form. tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {}
