"""One query per operator with the parameters it would have in production, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import (decontam, exact, extraction, fim, lm, packing, pii, quality, runs, secrets, sharding, simhash, spans,
                            substrings)
from floodspark.llm.common import documents, whole
from floodspark.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by shape and by entropy."""
    found = secrets.scan(documents(spark, sf_dir))
    counts = [secrets.counted(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, secrets.base_digest().alias("base_sha256"),
                        spans.written(F.col("spans"), secrets.KINDS).alias("spans"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measurements, failure bits and the verdict of the current policy for every document."""
    rows = quality.ledger(documents(spark, sf_dir))
    base_failed = ~quality.passes("base")
    return rows.select("doc_id", *quality.MEASURES[:5], base_failed.alias("base_failed"),
                       (~base_failed & quality.passes()).alias("kept"), "failed_bits")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(documents(spark, sf_dir, "pages"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 1024 tokens."""
    out = packing.pack(documents(spark, sf_dir), VOCABULARY, RANKS)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components within 3 bits."""
    out = simhash.near_duplicates(documents(spark, sf_dir), radius=3, shingle=3)
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, similar by 0.8 or more."""
    found = decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base shapes, and what the trained classifier adds."""
    found = pii.find(documents(spark, sf_dir))
    counts = [pii.counted(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, pii.base_digest().alias("base_sha256"),
                        spans.written(F.col("spans"), pii.KINDS, by_start=False).alias("spans"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the smoothed word counts and under the recurrent model."""
    return lm.score(documents(spark, sf_dir))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 8 shards of a ring with bounded loads: counts differ by one at most."""
    out = sharding.shard_documents(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
                      F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that also start elsewhere."""
    return substrings.remove_repeats(documents(spark, sf_dir), digest=True)


def looped(text: str | None, g: int) -> str:
    """The words of ``text`` from place ``g % n`` on replaced by the repetition of the first few of them."""
    words = (text or "").encode().split()
    n = len(words)
    if n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a:a + p] * -(-(n - a) // p))[:n - a]
    return b" ".join(words).decode()


def _looped(texts: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if g is None or g != g else looped(t, int(g)) for t, g in zip(texts, keys)], dtype=object)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, the longest of them, and the text without the repetitions.

    A tenth of the documents, by the hash of the id, first get a repeating tail.
    """
    docs = documents(spark, sf_dir)
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = h % 10 == 0
    tail = F.pandas_udf(_looped, "string")(F.when(picked, whole()), F.when(picked, F.floor(h / 10).cast("long")))
    found = runs.find_runs(docs.select("doc_id", F.coalesce(tail, "text").alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.period")).alias("period"), "runs_sha256", "collapsed_sha256").select(
        "doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and what is rebuilt from the result."""
    out = fim.fill_in_middle(documents(spark, sf_dir), texts=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical documents; the one with the largest id stays."""
    return exact.exact_groups(documents(spark, sf_dir), keep="largest")
