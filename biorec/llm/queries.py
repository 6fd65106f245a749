"""The registered queries of the corpus operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biorec.llm import dedup, frames, jaccard, langid, licenses, lines, mixing, periods, pieces, tokens, topk, toxicity, urls
from biorec.llm.common import materialize, small_batches, table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    out = licenses.scan_licenses(docs.select(F.col("doc_id").cast("long").alias("id"), path.alias("path"), "text"))
    return out.withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents")).drop("locator")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, and compare with the text (whose own white space marks decode to spaces)."""
    small_batches(spark)  # two workers of a task run beside each other
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(pieces.SPACE), F.lit(" ")).alias("text"))
    decoded = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    return decoded.select("doc_id", "n_chunks", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.xxhash64("decoded") == F.col("mark")).alias("round_trip"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents get a repeated tail first."""
    return periods.run_digests(periods.periodic_runs(periods.repeat_tails(table(spark, sf_dir, "documents"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = materialize(frames.store_frames(table(spark, sf_dir, "documents")), "frames")
    return frames.digests(frames.fill_in_middle(store))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mixing.SQL, "op4_exact_dedup": dedup.SQL, "op9_exact_topk": topk.SQL, "op10_url_filter": urls.SQL, "op12_line_dedup": lines.SQL, "op13_fill_in_middle": frames.SQL}
