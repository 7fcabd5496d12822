"""A training corpus from ``documents``: five stages, each written before the next one reads it.

1. toxicity: documents that the trained field scores as toxic go;
2. near_dedup: one document of each group of SimHash near-duplicates stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: sources are cut or repeated to their target weights;
5. sharding: rows get their shard and slot along a Hilbert curve.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import decontaminate, mixing, sharding, simhash, toxicity
from prosemill.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold by a field trained on ``labels``; null and empty texts stay, and with no labels all do."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group of near-duplicates; all null, empty and wordless texts are one group."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` within its edit budget; null and empty texts stay, and with no items all do."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it; one without words stays once. A null source is a source."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; repeated rows and null ids get places of their own."""
    return sharding.sharded(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Trained scores and edit matching are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
