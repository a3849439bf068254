"""A corpus pipeline of five operators: what it keeps is packed into training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read
again as the next one's docs. All but the last return the columns of documents (doc_id, text, lang, source, n_chars).

quality    rejects documents that fail the base or line-frequency rules; frequent lines are taken out of the others
toxicity   rejects documents scored 0.5 or more by a model fitted on the labels of the documents it gets
near_dups  keeps the smallest doc_id of each near-duplicate component
secrets    replaces every secret by a mark
pack       packs the documents, at most MAX_DOCS a sequence: one row a piece with its sequence and offset

Nulls, empty texts, repeated rows and empty tables have the results that the operators' modules define; an empty table
runs through to an empty result. Columns other than those of documents do not pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm import packing, quality_rules, secrets, simhash, toxicity
from marketlens.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a packed sequence, each of which is a block of its attention mask.
MAX_DOCS = 64
#: Toxicity is a fitted model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(quality_rules.quality_rules(docs).filter("kept"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_s", toxicity.score_column(spark, model)).filter("_s.score < 0.5").select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=100_000, keep=False, max_docs=MAX_DOCS)  # memory is left by earlier stages


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dups", near_dups), ("secrets", secret), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            if before is not None:
                discard(before)  # no later stage reads it
            before = docs
    return docs
