"""The queries of the training-data operators: each applies its operator to the whole table and returns every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, divergence, html_cut, language_id, license_scan, mixing, piecewise, probminhash, quality_fm, token_counts
from .common import fold, table

VOCABULARY = "word_bpe_49k.json"
#: Tokens from which a document is over the limit.
TOKEN_LIMIT = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, s = divergence.with_verdict(docs.select("doc_id", "text"), divergence.references(docs))
    return out.select("doc_id", *[F.col(f"{s}.{n}") for n, _ in divergence.FIELDS])


def quality_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_fm.Machine:
    return quality_fm.fit(docs, table(spark, sf_dir, "labels"), fold("id", 4) != 2)


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, s = quality_fm.with_quality(docs.select("doc_id", "text"), quality_machine(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(fold(n=4) == 2, F.lit(False)).alias("held_out"), f"{s}.score", f"{s}.predicted")


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs, fold(n=3) != 1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, s = language_id.with_language(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", F.coalesce(fold(n=3) == 1, F.lit(False)).alias("held_out"), f"{s}.lang_pred", f"{s}.score")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = bpe_codec.with_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", f"{s}.n_tokens", f"{s}.ids_sha256", f"{s}.decoded_sha256")


def op5_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compared(table(spark, sf_dir, "documents"))


def op6_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = html_cut.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", f"{s}.text", f"{s}.n_chars")


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class, and whether it is the one that stays."""
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = token_counts.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return out.select("doc_id", f"{s}.n_bytes", f"{s}.n_tokens", (F.col(f"{s}.n_tokens") > TOKEN_LIMIT).alias("over_limit"), f"{s}.chunk_tokens")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = license_scan.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"{s}.{n}") for n, _ in license_scan.FIELDS])


#: The columns of four queries that SQL can express (see sql.py), through the same operators.
BASES = {
    "divergence_base": (op1_divergence, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
    "piecewise_edits": (op5_piecewise, ("doc_id", "n_chars", "edited_sha256")),
    "mixing_targets": (op9_mixing, ("doc_id", "size", "source_size", "target")),
    "license_base": (op10_license_scan, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")),
}


def selected(query: Callable, columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_divergence, op2_quality_fm, op3_language_id, op4_bpe_codec, op5_piecewise, op6_html_cut, op7_probminhash, op8_token_counts, op9_mixing, op10_license_scan)} | {name: selected(*x) for name, x in BASES.items()}
