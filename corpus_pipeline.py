"""A corpus pipeline: toxicity, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), with docs as the stage before left them, and all but the
last return the columns of documents. Rows with a null doc_id are scored and packed like others
and are no one's duplicates; of rows that repeat a doc_id one, with the smallest text, is left after
the near-duplicate stage. Empty tables pass through; without labels to learn from the first two
stages keep every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import packing
from corpuskiln.llm.common import cut, table
from corpuskiln.llm.near_dedup import near_duplicates
from corpuskiln.llm.quality import quality
from corpuskiln.llm.toxicity import held_out_rows, toxicity, usable


def _new_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, with underscores before them until no column of docs has one."""
    taken = {c.lower() for c in docs.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, labels = _new_names(docs, "score", "predicted"), table(spark, sf_dir, "labels")
    if usable(labels, held_out_rows()).isEmpty():
        return docs
    return toxicity(docs, labels, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = _new_names(docs, "score", "predicted")
    return quality(docs, table(spark, sf_dir, "labels"), names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 or more: the smallest doc_id."""
    kept = near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    several = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return named
    (row,) = _new_names(docs, "row")
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    one = named.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return named.join(several, "doc_id", "left_anti").unionByName(one.select(f"{row}.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL can't express the two models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
