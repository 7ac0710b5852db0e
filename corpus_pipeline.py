"""From documents to packed token windows: drop toxic texts and near copies, drop benchmark text, mask personal data, pack.

All stages but the last return the columns of their input. Stages decide on rows, not on ids: rows without an id
and rows that repeat one are judged by their own text. A null text is empty, so it is kept until it is packed; nulls in
other columns stay; an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import near_dups, packing, pii
from rostrum.llm import toxicity as lexicon
from rostrum.llm.common import stored, table
from rostrum.llm.decontaminate import decontaminate


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the lexicon of the labelled documents does not call toxic."""
    weights, scale = lexicon.fit(docs, table(spark, sf_dir, "labels"))
    marked = docs.select(F.struct("*").alias("row"), "text")
    return lexicon.score_toxicity(marked, weights, scale, keep=["row"]).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group over shingles of five words: that with the smallest id, ids before none.

    The first row of an id goes by it; rows that repeat an id, or have none, go by a number beyond all ids that is
    written with the rows. Rows without words are in no group, and all stay.
    """
    key = next(n for n in ("_row", *(f"_row{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    ids = rows.where(F.col("doc_id").isNotNull()).select("doc_id", key)
    several = ids.groupBy("doc_id").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1 OR doc_id >= 1L << 62")
    later = stored(ids.join(several, "doc_id").where((F.col(key) != F.col("_first")) | (F.col("doc_id") >= 1 << 62)).select(key, F.lit(True).alias("_later")))
    own = F.when(F.col("doc_id").isNull() | F.col("_later"), F.col(key) + (1 << 62)).otherwise(F.col("doc_id"))
    marked = rows.join(later, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], own.alias(key))
    copies = stored(near_dups.near_duplicates(marked, size=5, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key)))
    return marked.join(copies, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which less than one word in twenty lies in a benchmark window."""
    marked = docs.select(F.struct("*").alias("row"), "text")
    return decontaminate(marked, table(spark, sf_dir, "benchmark"), keep=["row"]).where("NOT contaminated").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of data in place of every span; ``n_chars`` follows the new text."""
    marked = docs.select(F.struct("*").alias("row"), "text")
    found = pii.find_pii(marked, pii.fit(docs), keep=["row"], with_masked=True)
    new = {"text": F.col("masked"), "n_chars": F.coalesce(F.length("masked").cast("long"), F.col("row.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens, with the token ids of every piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
