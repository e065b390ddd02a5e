"""Exact dedup by content sort, native DataFrame operations only.

Sampled splitters (``repartitionByRange``) deal the normalised texts out by content, equal ones to one partition; the
sort of each partition (external, spilling) places equal bytes side by side, and the sort aggregate compares each
row's full bytes with its neighbour's and keeps the best identifier. Splitters compare the beginning of a text and a
hash of the whole, so what the driver samples is short however long the texts are.

A text with so many copies that they would fill a good part of a partition (more than a quarter of an even share) gets
a salt from its rows' ids, and spans many partitions; its parts, one short row for each salt, are added up after the
sort. There are at most four such texts for each partition, so their list has a bound and is broadcast; they are found
by an exact count of hashes. No other text has a salt: all its copies meet in the sort.

Defined results: null text counts as empty and empty texts are equal to each other; texts of only white space are
empty; ties go to the longer original, then the smaller id, null ids last; of rows equal in id and text one is kept;
an empty table gives an empty result; other columns are neither read nor returned by ``exact_dedup``, whatever their
names, and all of them are returned by ``kept_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_partitions, text_or_empty, written

#: The characters that normalising deletes: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Characters of the normalised text that splitters compare before the hash; hot texts for each partition at most; rows
#: up to which a text is never hot.
HEAD, HOT_SHARE, FEW = 32, 4, 32


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _hot_texts(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Hashes of the texts with more rows than FEW and than a HOT_SHARE-th of an even partition: at most HOT_SHARE * n."""
    counts = docs.select(F.xxhash64(normalised(text_or_empty(text_col))).alias("_hot")).groupBy("_hot").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > max(FEW, docs.count() // (HOT_SHARE * n))).select("_hot")


def _fragments(docs: DataFrame, id_col: str, text_col: str, best: Column, row: Column | None = None) -> DataFrame:
    """What the sort makes of each text: its digest, number of rows and best row; hot texts have a row for each salt."""
    n = shuffle_partitions(docs.sparkSession)
    text = text_or_empty(text_col)
    rank = F.struct((-F.length(text)).alias("neg_len"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    rows = docs.select(normalised(text).alias("_text"), rank.alias("_rank"), *([row.alias("_row")] if row is not None else [])).withColumn("_hash", F.xxhash64("_text"))
    salted = rows.join(F.broadcast(_hot_texts(docs, text_col, n)), F.col("_hash") == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_rank.id", "_rank.neg_len"), F.lit(n)))
    keyed = salted.select(F.encode("_text", "UTF-8").alias("_norm"), F.substring("_text", 1, HEAD).alias("_head"), "_hash", salt.alias("_salt"), "_rank", *(["_row"] if row is not None else []))
    return (
        keyed.repartitionByRange(n, "_head", "_hash", "_salt")
        .groupBy("_head", "_hash", "_salt", "_norm")
        .agg(F.count(F.lit(1)).alias("_n"), best)
        .select(F.sha2("_norm", 256).alias("_sha"), "_salt", "_n", "_best")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    # Written, so that the join below reads two plain shuffles, of which adaptive execution may split a large partition.
    parts = _fragments(docs, id_col, text_col, F.min("_rank").alias("_best"))
    groups = written(parts.groupBy("_sha").agg(F.sum("_n").alias("group_size"), F.min("_best").alias("_best")), "text-groups")
    text = text_or_empty(text_col)
    # Rows equal in id and text meet here, so that one of them stays; the shuffle carries digests, never texts.
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("_sha"), F.length(text).alias("_len"))
        .groupBy("doc_id", "_sha", "_len")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    first = F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("_len") == -F.col("_best.neg_len"))
    return (
        rows.join(groups, "_sha")
        .select("doc_id", F.col("_best.id").alias("keep_id"), "group_size", first.alias("_first"), "_sha", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("_first") & (F.col("_copy") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"))
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stays of each text, with all its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = F.min_by(F.struct("_rank", "_row"), "_rank").alias("_best")
    parts = _fragments(docs, id_col, text_col, whole, row)
    return parts.groupBy("_sha").agg(F.min_by("_best", "_best._rank").alias("_best")).select("_best._row.*")
