"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); the result of one, written as Parquet and
read again, is the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamwright.llm.common import materialize, read_table
from seamwright.llm.line_crf import fit_line_crf, keep_good
from seamwright.llm.ngram_join import jaccard_classes
from seamwright.llm.packing import pack
from seamwright.llm.queries import tokenizer_file
from seamwright.llm.raking import rake_and_sample
from seamwright.llm.substring_dedup import remove_repeats

#: Near duplicates share this percentage of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line CRF keep."""
    return keep_good(docs, fit_line_crf(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of smallest doc_id, of repeated rows one.

    Ids that are null or carry several texts are told apart by a hash of id and text, below zero, so that no text goes that is found nowhere else.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    clash = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("__nd_clash"))
    marked = docs.join(materialize(clash, "clash"), F.col("doc_id") == F.col("__nd_clash"), "left")
    odd = F.col("doc_id").isNull() | F.col("__nd_clash").isNotNull()
    own = F.when(odd, -1 - F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(1 << 62))).otherwise(F.col("doc_id").cast("long"))
    keyed = marked.withColumn("__nd_id", own).drop("__nd_clash")
    classes = jaccard_classes(keyed.select(F.col("__nd_id").alias("doc_id"), "text"), SHINGLE, PERCENT).select("doc_id", "component_id")
    ids = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    ids = materialize(ids.where("doc_id <> component_id or rows > 1").select(F.col("doc_id").alias("__nd_of"), (F.col("doc_id") != F.col("component_id")).alias("__nd_gone")), "gone")
    left = keyed.join(ids, F.col("__nd_id") == F.col("__nd_of"), "left").where("__nd_gone is null or not __nd_gone")
    once = left.where("__nd_gone is null")
    # of rows that share id and text only the first of each task is shuffled
    order = Window.partitionBy("__nd_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    repeated = left.where("__nd_gone is not null").withColumn("__nd_row", F.row_number().over(order)).where("__nd_row = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(repeated.select(*columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; texts without any keep their form."""
    out = remove_repeats(docs, keep_form=True)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.col("__sd_n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens fit target shares of sources, languages and topics."""
    return rake_and_sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op1 returns them."""
    return pack(docs, tokenizer_file)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models, similarity classes and packing are beyond one SQL statement; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
