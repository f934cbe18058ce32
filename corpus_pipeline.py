"""From documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import hyperminhash, langid, linededup, packing, secrets
from fathom.llm.common import Scratch, table

#: Each takes (spark, docs, sf_dir).  All but the last return documents with the columns they came with.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", langid.stage),
    ("line dedup", linededup.stage),
    ("MinHash near-dedup", hyperminhash.stage),
    ("secret scans", secrets.stage),
    ("best-fit packing", packing.stage),
]

#: The stages can't be said in SQL; a brute-force version of each tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet to the shared folder, where the next one reads it.

    Null and empty texts go with language ID; documents of which line dedup leaves
    nothing go with it; of repeated ids and rows each is treated by its text, so equal
    ones leave one; further columns pass through all stages but the last, whatever
    their names; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(f"stage{i}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
