"""Token ids of documents and the exact histogram of their lengths."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, raw_texts, small_batches, written

#: Vocabulary of the byte-level BPE, by its name among the public tokenizers or by path.
VOCABULARY = "byte_bpe_50k.tiktoken"


#: Special tokens of a rank file, which has none of its own: string and id.
SPECIAL = {"byte_bpe_50k.tiktoken": {"<|endoftext|>": 50256}}


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, special_as_text: bool = False):
    """Function from text to ids, loaded once per worker process.

    A ``.tiktoken`` rank file is read by tiktoken, a ``.json`` file by tokenizers; for
    ``byte_bpe_50k`` both give the same ids (tests compare them) and tiktoken is faster.  The
    string of a special token within a text gives that token, as tokenizers does without
    settings; with ``special_as_text`` it is ordinary text.
    """
    import public_tokenizers

    path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = special_as_text
        return lambda text: model.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = SPECIAL.get(os.path.basename(path), {})
    model = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    if special_as_text or not special:
        return model.encode_ordinary
    marks = tuple(special)
    return lambda text: model.encode(text, allowed_special="all") if any(m in text for m in marks) else model.encode_ordinary(text)


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, end_tokens: int = 1) -> DataFrame:
    """Documents by encoded length: ``length``, ``n_docs``, counted per batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(vocabulary), Counter()
        for batch in small_batches(batches, "text"):
            counts.update(len(encode(raw.decode("utf-8", "replace"))) + end_tokens for raw in raw_texts(batch.column(0)))
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], names=["length", "n"])

    found = documents_of(docs.select(F.lit(None).alias("doc_id"), "text")).select("text").mapInArrow(run, "length long, n long")
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, end_tokens: int = 1, block: int = 1024) -> DataFrame:
    """Exact histogram of encoded lengths with what every context limit needs.

    Per length ``L`` that occurs: ``n_docs`` documents of that length; ``docs_over`` and
    ``tokens_over``, documents longer than ``L`` and their tokens (suffix sums); ``docs_total``
    and ``tokens_total``; ``tokens_within``, the corpus's tokens when each document is cut at
    the limit ``L``; ``quantile``, the share of documents of at most ``L`` tokens.  Null and
    empty texts have only their end token.  An empty table gives no rows.

    Suffix sums run within blocks of lengths, and over the blocks, so no task sorts more than
    ``block`` lengths or one row per block.
    """
    counts = written(lengths(docs, vocabulary, end_tokens), "lengths", small=True)  # used twice, encoded once
    counts = counts.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("docs_total"),
        F.sum("block_tokens").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("later_tokens") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_over"),
        "docs_total",
        "tokens_total",
    )
    return rows.withColumn("tokens_within", F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).withColumn("quantile", 1 - F.col("docs_over") / F.col("docs_total"))
