"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all its predecessor
kept.  All but the last return the columns of ``documents``, unchanged; the last returns the
pieces of documents and where they lie in the training sequences.

In every stage a null text counts as an empty one, a null id or source is a value of its own,
texts are read whole whatever their length, extra columns pass through whatever their names,
and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import common, exact_dedup, mixing, packing, similar_texts, toxicity

#: SQL cannot express the classifier, the components and the packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3, by a classifier fitted on this stage's input.

    Texts without words get the score of such a text.  Rows that repeat a text go or stay
    together; rows that repeat an id are scored one by one.  Labels of unknown documents, and
    null labels, are not used; without labels every document stays.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original with the smallest id.

    All texts without words are equal, so one of them stays.  A null id is the last choice; of
    rows that repeat both id and text one stays.
    """
    return common.rows_of(docs, exact_dedup.exact_duplicates(docs), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Documents whose sets of five-word shingles are 0.8 or more alike are linked, and groups are
    what is linked directly or over others; texts of fewer words have one shingle, those
    without words none and are one group.  No document goes for another it is not linked to;
    of the pairs just at 0.8 about 2 % may be missed, fewer above it.  A null id is the last
    choice; of rows that repeat both id and text one stays.
    """
    return common.rows_of(docs, similar_texts.similar_documents(docs), "leads")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources meet their target weights.

    Sources by code point weigh 1, 2, 3, repeating, the null one last; none is taken over three
    times.  A source misses its target by half of one document at most.  Rows that repeat both
    id and text are taken alike; texts without words go with the share of their source.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each repetition on its own, in sequences of 1024 tokens.

    A text without words is one piece that holds only the end of a document; a text of more
    than 1024 tokens is cut and loses nothing.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{number}")
    return docs
