"""A corpus pipeline of five stages: language identification, exact dedup, near-dedup, decontamination, token ids.

Each stage works on all rows that its predecessor kept. run() writes each stage's rows to the shared folder and reads
them back, so no stage is computed twice and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_bpe, decontaminate, exact_dedup, langid, simhash
from granary.llm.common import cut, discard, is_stored
from granary.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified (langid.keep_identified). Null texts, texts with no letter and texts unlike all that was learned go.

    Each row is decided by its own text: ids, repeated or null, decide nothing. Columns stay as they are, whatever their
    names. If no row has a language to learn from, none is identified and none stays. An empty table stays empty.
    """
    return langid.keep_identified(docs, langid.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of equal texts: the smallest doc_id, null last, of equal ids the first row.

    Null text is the empty text. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    return exact_dedup.drop_copies(docs, stored=is_stored(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: the smallest doc_id, null last, of equal ids the first row.

    Rows with no words are one component. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    return simhash.keep_one(docs, stored=is_stored(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows in which no window of a benchmark item occurs; null texts stay, as do all rows if there are no items.

    Each row is decided by its own text. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, packed token ids, their number and digest, and the digest of the text that they decode to, of every row.

    Null text is the empty text. Rows that repeat an id, or have none, get a row each. Other columns are not read. An empty table gives an empty result.
    """
    found = byte_bpe.round_trip(docs)
    return found.select("doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", clean), ("byte-level BPE", tokens)]
#: Token ids and the field's probabilities are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next is written; the result reads that of the last but one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline")
        if hasattr(before, "cut_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
