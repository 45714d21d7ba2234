"""A training-data pipeline of five stages over ``documents``.

    python -c "import corpus_pipeline as p; p.run(spark, folder)"

Every stage takes the session, the documents its predecessor kept and the folder of the tables, and
returns what it keeps: the columns of documents for all but the last, which returns packed rows. Null and
empty texts are clean to the first stage, linked with nothing by the second, free of items for the third,
of size 0 for the fourth and an end id alone in the fifth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import decontamination, mixing, near_duplicates, packing, toxicity
from patronlens.llm.common import remainder, table
from patronlens.session import cut_lineage

#: The stages' decisions depend on a fitted score and on hashes that DuckDB does not have.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; the score learns from the labels whose id is not held out."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("_document"), "text"), model)
    return scored.where("predicted = 0").select("_document.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of 0.8 on five-word shingles."""
    return near_duplicates.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words, and no whole shorter item, of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids."""
    return packing.packed(docs, packing.read_vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
