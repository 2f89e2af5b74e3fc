"""From raw documents to shards of training data: five stages, each over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an empty
table and columns of any name; what it does with them is said at each. All but the last return
the columns they were given, with their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.llm.common import bound_batches, held_out, release, table, written
from siglake.llm.decontam import without_leaks
from siglake.llm.jaccard_join import keep_one
from siglake.llm.mixing import mix_sources
from siglake.llm.quality import keep_good, learn_quality
from siglake.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good.

    A null text is judged as an empty one; repeated rows stand or fall together; without labels
    no document is predicted to be good. Null ids are learned from by no label, but judged.
    """
    ranking = learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return keep_good(docs, ranking)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets that a similarity of 0.8 or more links.

    The least id stays (null ids are larger than any other), of equal ids the text of the least
    hash; of rows that repeat id and text one. Texts without words all stay.
    """
    return keep_one(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing; repeated rows stand or fall together; an empty benchmark leaves all."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. A null source is a source, the last; null texts have no words but are sampled; repeated rows are sampled each."""
    return mix_sources(docs, expand=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows with shard, slot and the shard that one more would give.

    All rows of an id, null among them, share a shard; each row has a slot of its own. Input
    columns named like these three give way to them.
    """
    return shard_documents(docs, 16)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("sharding", shards)]

#: Ranking, similarity classes, alignment and Fisher-Yates shuffling are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            release(before)
    return docs
