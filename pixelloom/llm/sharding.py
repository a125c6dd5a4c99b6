"""Shards with the mixture of the corpus: proportional stratified interleaving, in DataFrame functions.

Rows of each source are ranked in a seeded shuffle; the fractional rank
(rank - 1/2) / n spreads every source evenly over 0 .. 1. All rows in the order
of that fraction are cut into runs of equal count, so every run holds every
source in its proportion, and whole-number rounding is all that differs.

Ranks are exact without a sort of everything in one task: positions are counted
per slice of the shuffle (or of the fraction), and only the slices' counts are
summed up; a slice holds about SLICE_ROWS rows, however large its source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 20_000


def _numbered(rows: DataFrame, stratum: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Adds `name`, the 1-based position in the order (part, *order) within the stratum, and name_of, its size."""
    counts = rows.groupBy(*stratum, part).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*stratum) if stratum else Window.partitionBy()
    counts = counts.select(
        *(F.col(c).alias(f"_{c}") for c in (*stratum, part)),
        (F.sum("_n").over(along.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(along).alias(f"{name}_of"),
    )
    same = F.lit(True)
    for c in (*stratum, part):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(Window.partitionBy(*stratum, part).orderBy(*order))
    return rows.withColumn("_own", own).join(counts, same).withColumn(name, F.col("_before") + F.col("_own")).drop(
        "_own", "_before", *(f"_{c}" for c in (*stratum, part))
    )


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot: one row per row of docs(doc_id, text, source).

    Law `rows`: shard counts differ by one at most. slot numbers the rows of a
    shard from 0 without gaps, in the interleaved order. size is the number of
    UTF-8 bytes of the text (null: 0) plus 1; text_crc32 is that of the text
    (null: of no bytes). A null source is a source of its own. Ties of the
    shuffle are ordered by doc_id, size and checksum, so only rows alike in all
    of them may change places. More shards than rows leave the last ones empty;
    an empty table gives an empty table; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    slices = max(1, -(-total // SLICE_ROWS))
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id")))
    drawn = drawn.withColumn("slice", F.floor((F.col("draw") / float(1 << 63) + 1.0) / 2 * slices).cast("long"))
    ranked = _numbered(drawn, ["source"], "slice", ["draw", "doc_id", "size", "text_crc32"], "rank")
    spread = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("rank_of")).withColumn(
        "stretch", F.floor(F.col("fraction") * slices).cast("long")
    )
    placed = _numbered(spread, [], "stretch", ["fraction", "source", "rank"], "position")
    at = F.col("position") - 1
    shard = F.expr(f"((position - 1) * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard", (at - first).cast("long").alias("slot")
    )
