"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearwell.llm import decontaminate, pieces, shingle_join, substring_dedup, toxicity
from clearwell.llm.common import prepare, table, written
from clearwell.llm.queries import END_ID, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled rows that no test holds out.

    Null and empty texts get the score of texts without a window; rows that
    repeat are judged alike; no column is added, changed or read but doc_id and
    text; an empty table, or one without labelled rows, loses nothing.
    """
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_from(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one document with the smallest doc_id.

    Texts without words have no copies and stay, null ones too; of rows that
    repeat one stays; a null doc_id counts as the smallest; rows that share an id
    are told apart by their text; columns stay as they are.
    """
    return shingle_join.dedup(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of nothing else goes.

    n_chars follows the text where some of it went; all other columns stay as
    they are.  Null and empty texts stay.  Rows that share an id count as one document.
    """
    return substring_dedup.cut_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth.

    Texts without words are clean; rows are judged one by one; columns stay as
    they are; an empty benchmark or table loses nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids of each text, its end id included.

    A null text is an empty one; rows that repeat are encoded one by one; columns
    other than doc_id and text are not read.
    """
    prepare(spark)
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL has neither the classifier nor the encoder; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
