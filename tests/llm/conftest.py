from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source)."""

    def docs(rows, schema=SCHEMA):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], schema)

    return docs


#: Nulls, empty and blank texts, repeated rows, ties, one long text.
ODD = [(None, None, None), (None, "a null id", "s"), (1, None, "s"), (2, "", "t"), (3, " \n\t ", None), (4, "one", "s"), (4, "one", "s"), (5, "two words", "s"), (6, "x " * 30000 + "end", "long"), (7, "one", "t")]
