"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.llm import language, line_runs, mixing, near_duplicates, pieces
from pixelmill.llm.common import checkpoint_folder, unused

#: A prediction of lower posterior probability rejects the document.
SURE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; NULL and letterless texts go."""
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    lang, score = unused(docs, "_lang"), unused(docs, "_score")
    found = language.identify(docs, model, out=(lang, score))
    return found.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= SURE)).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out; documents of which nothing is left go. n_chars follows the text."""
    found = line_runs.remove_repeats(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    found = found.filter((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return found.select(*[size.alias(c) if c == "n_chars" else c for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least doc_id."""
    return near_duplicates.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents of the mix; a document taken twice has a copy number, so its rows are cut differently."""
    docs = docs.select("doc_id", "lang", "source", "text")
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
    found = pieces.encode(docs.withColumn("copy", F.row_number().over(alike)), copy="copy")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("language ID", identified),
    ("line dedup", without_repeats),
    ("MinHash near-dedup", one_of_each),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: Naive Bayes, order min-hash and merge-dropout have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete what a stage has read, once its own result is written; the folder may be in any store that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written into the session's shared checkpoint folder."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            dropped(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
