"""The corpus pipeline: language, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents; the last returns the packed pieces. run() writes each stage to the shared folder
and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import fresh_path, scratch
from harvestry.llm.exact_dedup import dedup
from harvestry.llm.language import identify, learn
from harvestry.llm.minhash import near_duplicates
from harvestry.llm.mixing import mix
from harvestry.llm.packing import default_tokenizer, pack_documents

#: A document goes if it is `und`, or if so small a part of its letter n-grams belongs to its language, BENEFIT n-grams
#: that do added to each: a few words alone don't tell enough to go by.
LEAST_COVERAGE, BENEFIT = 0.05, 4


def row_key(docs: DataFrame) -> DataFrame:
    """docs with `key`, which tells rows apart that share a doc_id but not their text, and other columns away."""
    return docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).alias("key"), "text", "source")


def by_key(docs: DataFrame, kept: DataFrame, how: str) -> DataFrame:
    """docs joined with `kept` (key and more); null ids match null ids."""
    left = docs.withColumn("pipeline_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    kept = kept.select(F.col("key.doc_id").alias("pipeline_id"), F.col("key.sha").alias("pipeline_of"), *[c for c in kept.columns if c != "key"])
    return left.join(kept, F.col("doc_id").eqNullSafe(F.col("pipeline_id")) & (F.col("pipeline_sha") == F.col("pipeline_of")), how)


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; text without letters, or in no such language, goes. Words too few to tell stay.

    Null text goes, as it has no letters; rows that repeat one another all stay or go; no rows give no rows;
    columns that aren't of documents are kept as they are, and a long text is read whole.
    """
    columns = tuple(docs.columns)
    said = identify(docs.withColumn("pipeline_text", F.col("text")), learn(docs), text_col="pipeline_text", carry=columns)
    share = (F.col("coverage") * F.col("n_grams") + BENEFIT) / (F.col("n_grams") + BENEFIT)
    return said.where((F.col("lang_pred") != "und") & (share >= LEAST_COVERAGE)).select(*docs.columns)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the smallest doc_id. Rows that repeat a doc_id and its text count once.

    Null text counts as empty; a null doc_id stays only among nulls; no rows give no rows.
    """
    kept = dedup(docs, keep="min").where("kept").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("key")).distinct()
    rows = by_key(docs, kept, "left_semi")
    return rows.dropDuplicates(["doc_id", "pipeline_sha"]).select(*docs.columns)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest doc_id.

    A text without words is no copy and stays. Rows that share a doc_id are told apart by their texts; null ids come
    last within a group; no rows give no rows.
    """
    kept = near_duplicates(row_key(docs), id_col="key").where("kept").select("key").distinct()
    return by_key(docs, kept, "left_semi").select(*docs.columns)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; a text without words has none, a null source is a source of its own; no rows give no rows."""
    copies = mix(row_key(docs), id_col="key").where("copies > 0").select("key", F.col("copies").alias("pipeline_copies"))
    each = F.explode(F.sequence(F.lit(1), F.col("pipeline_copies").cast("int"))).alias("pipeline_copy")
    return by_key(docs, copies, "inner").select(*docs.columns, each).drop("pipeline_copy")


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens. Null text is empty, repeated rows are packed each for itself, and long texts are cut at 4096 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("pack", packed)]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what the stage stages goes once its rows are written
            done = stage(spark, docs, sf_dir)
            done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
