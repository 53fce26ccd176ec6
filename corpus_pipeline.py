"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its input is all that the
stage before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm import bpe, decontam, lines, neardup, toxicity
from lumenweave.llm.common import cut, read


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, *bpe.default_vocabulary())


STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontam.stage),
    ("byte_bpe", _encoded),
]

#: A learned classifier takes part, which SQL can't express; every stage has tests of its own on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
