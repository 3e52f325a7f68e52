"""From documents to training shards: filter, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; run() writes each
result as Parquet to the shared folder and gives the next stage what it reads back.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.llm.lpt import sharded
from velobus.llm.pfair import in_mixed_order
from velobus.llm.shared import in_written_order, shared_folder
from velobus.llm.superminhash import without_copies
from velobus.llm.templates import without_contaminated
from velobus.llm.toxicity import without_toxic
from velobus.session import tune


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, takes for toxic go."""
    return without_toxic(docs, tune(spark).read.parquet(f"{folder}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies (0.8 of five-word shingles) the smallest doc_id stays."""
    tune(spark)
    return without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go."""
    return without_contaminated(docs, tune(spark).read.parquet(f"{folder}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows, in the order in which sources alternate by their target weights. Rows read from files
    are scheduled by their places there, so that the texts move only to be put into order."""
    tune(spark)
    if not docs.inputFiles():
        return in_mixed_order(docs)
    return in_mixed_order(in_written_order(docs, "_place"), key="_place")


def sharding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each document goes: shard and slot. Slots follow the order in which mixing wrote the
    rows, so every shard is read in the proportions of the mixture; without files there is none."""
    tune(spark)
    if not docs.inputFiles():
        return sharded(docs)
    return sharded(in_written_order(docs, "_place"), order=F.col("_place"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
# A trained classifier and connected components are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The result of the last stage over documents; every stage's result lies in the shared folder."""
    docs = tune(spark).read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
