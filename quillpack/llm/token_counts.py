"""Exact length histogram of a corpus, with suffix sums for every context limit.

Documents are aggregated by encoded length, so what follows the encoding has
one row per distinct length. Suffix sums over lengths run in blocks of lengths
first and over the block totals then, so no task holds the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpack.llm.fast_ids import encoder
from quillpack.llm.store import settle, ship_code


def token_lengths(df: DataFrame, *, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens (long) of every row; a null text counts as empty and has 0 tokens."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(ids(t.as_py())) if t.is_valid else 0 for t in batch.column(0)], pa.int64())], names=["n_tokens"])

    return df.select(df[text_col]).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, *, block: int = 32) -> DataFrame:
    """One row per distinct n_tokens of ``lengths``, read as a context limit of that many tokens.

    n_docs: documents of exactly that length; docs_within and tokens_within: those
    no longer than the limit; docs_longer and tokens_longer: the others;
    truncated_total: tokens left when every document is cut at the limit;
    lost_tokens: what that cuts off; share_within: docs_within over all documents,
    so the q-quantile of lengths is the smallest limit with share_within >= q.
    An empty table gives no rows.
    """
    counts = settle(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))  # used twice, so that no text is encoded again
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumns({
        "docs_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
        "tokens_in": F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)),
    })
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens"))
    above, whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    longer, tokens = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return rows.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.col("all_docs") - longer).alias("docs_within"),
        (F.col("all_tokens") - tokens).alias("tokens_within"),
        longer.alias("docs_longer"),
        tokens.alias("tokens_longer"),
        (F.col("all_tokens") - tokens + longer * F.col("n_tokens")).alias("truncated_total"),
        (tokens - longer * F.col("n_tokens")).alias("lost_tokens"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share_within"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer and truncated_total for any limits, also between the lengths that occur; zeros where there are no documents."""
    limits = [int(x) for x in limits]
    longer = [F.sum((F.col("n_tokens") > x).cast("long") * F.col("n_docs")) for x in limits]
    kept = [F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")) for x in limits]
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(a, F.lit(0)).alias("docs_longer"), F.coalesce(b, F.lit(0)).alias("truncated_total")) for x, a, b in zip(limits, longer, kept)]
    return histogram.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
