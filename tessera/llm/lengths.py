"""Token counts: the exact histogram of encoded lengths, and suffix sums that answer for every context limit.

Documents are encoded whole and tallied by length within each task before anything is shuffled.  The histogram has one
row per distinct length, and its suffix sums come in two levels (within blocks of ``BLOCK`` lengths, then over the
blocks), so no task orders more than a block or one row per block.

Defined cases: null and empty texts have length 0; an empty table gives no row; repeated rows count each time.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts
from .tokens import default_path, encoder

BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(length, n_docs)`` over all documents."""
    path = path or default_path()

    def tally(texts):
        n = Counter(len(ids) // 4 for ids in encoder(path).encode_batch(texts))
        return {"length": list(n), "n_docs": list(n.values())}

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_texts(texts, "length long, n_docs long", tally).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length: n_docs, docs_from and tokens_from (documents at least that long, and their tokens),
    truncated_tokens (what is left of all documents at that context limit), share_upto (quantile of the length).

    The histogram is read several times, so it is written once to the checkpoint folder."""
    tokens = F.col("length") * F.col("n_docs")
    h = Scratch(histogram.sparkSession).cut(histogram).withColumns({"block": F.floor(F.col("length") / block), "tokens": tokens})
    total = h.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    inner = Window.partitionBy("block").orderBy(F.desc("length"))
    outer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(outer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("all_tokens").over(outer), F.lit(0)).alias("tokens_after"),
    )
    docs_from: Column = F.sum("n_docs").over(inner) + F.col("docs_after")
    tokens_from: Column = F.sum("tokens").over(inner) + F.col("tokens_after")
    out = h.join(blocks, "block").withColumns({"docs_from": docs_from, "tokens_from": tokens_from})
    return out.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.lit(total.tokens) - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.lit(total.docs) - F.col("docs_from") + F.col("n_docs")) / F.lit(total.docs)).alias("share_upto"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents longer than it would have to be cut (``docs_cut``), and the tokens left of all."""
    contexts = F.array(*[F.lit(x).cast("long") for x in limits])
    longer = F.col("length") > F.col("context")
    first = F.min(F.when(longer, F.struct("length", "docs_from", "tokens_from")))
    return (
        sums.withColumn("context", F.explode(contexts))
        .groupBy("context")
        .agg(first.alias("s"), F.sum(F.col("length") * F.col("n_docs")).alias("total"))
        .select(
            "context",
            F.coalesce("s.docs_from", F.lit(0)).alias("docs_cut"),
            (F.col("total") - F.coalesce("s.tokens_from", F.lit(0)) + F.col("context") * F.coalesce("s.docs_from", F.lit(0))).alias("tokens_left"),
        )
    )
