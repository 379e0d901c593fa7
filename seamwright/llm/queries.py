"""The registered queries of these operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def tokenizer_file() -> str:
    """Called on the executors: the vocabulary file is looked up where it is read."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens by fitted length patterns."""
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file)


def op2_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by path rules, else by mined association rules."""
    from .url_rules import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), read_table(spark, sf_dir, "labels"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without the subtrees that recur on its host."""
    from .html_templates import extract_text

    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in all documents where a license template stands, with matched coverage and spans."""
    from .license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that links of 4-word shingle Jaccard 0.85 join."""
    from .ngram_join import jaccard_classes

    return jaccard_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50, among all vectors."""
    from .ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the line CRF (see line_crf)."""
    from .line_crf import fit_line_crf, line_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = fit_line_crf(docs, read_table(spark, sf_dir, "labels"))
    return line_quality(docs, crf)


def op8_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the token CRF, which never sees labels of held-out rows."""
    from .toxic_spans import THRESHOLD, fit_token_crf, toxic_scores

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = fit_token_crf(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held))
    return toxic_scores(docs, crf).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, calibrated probability and decision of every document of the mixture."""
    from .raking import calibrated

    out = calibrated(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", F.col("__rake_topic").alias("topic"), F.col("__rake_p").alias("probability"), F.col("__rake_kept").alias("kept"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document once the repeated 35-word windows are gone."""
    from .substring_dedup import remove_repeats

    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__sd_n_words").alias("n_words"), F.col("__sd_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent near word that each is a variant of."""
    from .spelling import spelling_forms

    return spelling_forms(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def aligned_files() -> tuple[str, str]:
    """Called on the executors, like tokenizer_file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least common groups of two tokenizers' tokens in every document, and how its links rank in the corpus."""
    from .cross_tokens import align_tokens

    return align_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), aligned_files)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in every document once those found in ten documents or more are gone."""
    from .line_dedup import drop_common_lines

    out = drop_common_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__ld_n_lines").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the results that one statement can have; tests hold the others against brute force."""
    from .oracles import ORACLES

    return dict(ORACLES)
