"""A pipeline over ``documents``, from raw texts to token ids.

Each stage calls one operator on all rows that its predecessor kept and returns a DataFrame, which is written as
Parquet and reread as the next stage's ``docs``; all but the last return the columns of ``documents``.

1. toxicity: rows that score 0.7 or more go;
2. quality: rows that score under 0.3 go;
3. near-duplicates: of each group of linked fingerprints the row with the smallest id stays;
4. decontamination: rows with an occurrence of a benchmark window go;
5. byte-level BPE: one row of token ids for each document that is left.

Models are learned inside their stage, from ``labels`` and the stage's own input, with the same splits as the
operators' queries.

Null and empty texts count as clean text without words: they have no toxic match, get the quality score of an empty text, are copies of one
another, hold no benchmark window, and have no tokens. Texts are read whole, however long. Of rows that repeat an id, those with one text are one row to
the third stage, and those with other texts stand for themselves; rows without an id are kept by it. Empty tables give empty results; without labels the
starting grammar rejects and no text is poor; without benchmark items nothing is contaminated. Columns besides ``doc_id`` and ``text`` are carried along, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, quality, simhash, toxicity
from plumbline.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.learn_grammar(docs, table(spark, sf_dir, "labels"), spark, toxicity.train_rows(3, 1))
    return toxicity.keep_clean(docs, grammar, spark)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"), spark, quality.train_rows(5, 0))
    return quality.keep_good(docs, model, spark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, spark)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), spark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: Trained scores and merges of byte pairs are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, spark)
    return docs
