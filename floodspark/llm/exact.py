"""Exact duplicates by a 128-bit content hash, with bytes compared inside groups.

Copies are counted before they move: grouping by hash *and* text compares bytes wherever hashes agree, and each
task sends a text once however many copies it holds.  From then on documents travel as hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import bounded, whole
from floodspark.session import cut

#: A group with more than one row in ``SHARE`` of all is hot; there are at most ``SHARE`` of them, so they are broadcast.
SHARE = 512


def content_hash(body: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(body.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] = lambda body: body,
                 hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after ``normalise``; the ``smallest`` or ``largest`` id of a group stays.
    A null text is an empty one.  Ids are taken for unique: rows that repeat the kept id within its group are kept
    together.  Rows without an id count but are kept only where no row of the group has one (``keep_id`` is null).
    An empty table gives an empty result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    body = normalise(whole(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("h", hashed(F.col("body")))
    counted = lambda df: df.groupBy("h", "body").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    classes = cut(counted(rows).select("h", "keep_id", "n"), "classes")
    groups = cut(classes.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), best("keep_id").alias("keep_id"))
                 .where("n > 1"), "groups")
    total, collisions = groups.agg(F.sum("n"), F.count_if(F.col("texts") > 1)).first()
    tie = F.lit("").alias("tie")
    found = groups.where("texts = 1").select("h", tie, "keep_id", "n")
    if collisions:  # different texts with one hash: their documents carry the text along
        shared = bounded(groups.where("texts > 1").select("h", F.lit(True).alias("shared")), collisions)
        rows = rows.join(shared, "h", "left")
        tie = F.when(F.col("shared"), F.col("body")).otherwise(F.lit("")).alias("tie")
        apart = counted(rows.where("shared")).where("n > 1")
        found = found.unionByName(apart.select("h", F.col("body").alias("tie"), "keep_id", "n"))
    narrow = rows.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256"), tie)
    limit = (total or 0) // SHARE
    hot = found.where(F.col("n") > limit).select("h", "tie", F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))
    rest = found.where(F.col("n") <= limit)
    # rows that are settled go on under keys of their own, so they spread instead of meeting
    own = F.concat(F.lit("\0"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    settled = narrow.join(F.broadcast(hot), ["h", "tie"], "left")
    settled = settled.withColumn("tie", F.when(F.col("hot_n").isNull(), F.col("tie")).otherwise(own))
    joined = settled.join(rest, ["h", "tie"], "left")
    size = F.coalesce("hot_n", "n", F.lit(1)).cast("long")
    keep_id = (F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).when(F.col("n").isNotNull(), F.col("keep_id"))
               .otherwise(F.col("doc_id")))
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text",
                normalise: Callable[[Column], Column] = lambda body: body) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay; cases as in ``exact_groups``."""
    gone = exact_groups(docs, keep, doc_id, text, normalise).where("NOT kept").select(
        F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text"))
    same = docs[doc_id].eqNullSafe(F.col("_gone_id")) & (F.sha2(normalise(whole(docs[text])), 256) == F.col("_gone_text"))
    return docs.join(gone, same, "left_anti")
