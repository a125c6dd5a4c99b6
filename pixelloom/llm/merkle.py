"""Merkle trees of documents in DataFrame functions: root, sections, paragraphs, sentences.

A section ends with a blank line, a paragraph with its line, a leaf with a
sentence or after LEAF_CHARS characters without an end. Every character belongs
to exactly one leaf, so equal roots mean equal texts, and an edit changes its
leaves and the nodes above them, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_CHARS = 120
SECTION = r"(?s).+?(?:\n[ \t\r]*\n\s*|\z)"
PARAGRAPH = r"[^\n]*+\n++|[^\n]++"
LEAF = rf"[^.!?]{{0,{LEAF_CHARS}}}+[.!?]++\s*+|[^.!?]{{1,{LEAF_CHARS}}}+"


def leaves(text: Column) -> Column:
    """array<array<array<string>>>: leaf texts by section and paragraph; none for an empty text."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)),
        lambda s: F.transform(
            F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)),
            lambda p: F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)),
        ),
    )


def leaf_hashes(text: Column) -> Column:
    """The tree of leaf hashes (16 hex digits of sha256)."""
    return F.transform(
        leaves(text), lambda s: F.transform(s, lambda p: F.transform(p, lambda x: F.substring(F.sha2(x, 256), 1, 16)))
    )


def paragraph_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.concat(F.lit("p"), F.array_join(p, "")), 256)))


def section_hashes(tree: Column) -> Column:
    return F.transform(paragraph_hashes(tree), lambda s: F.sha2(F.concat(F.lit("s"), F.array_join(s, "")), 256))


def root(tree: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.array_join(section_hashes(tree), "")), 256)


def flat(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct leaf hashes (0 to 1); 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, sections, paragraphs, leaves: the tree of every row of docs(doc_id, text).

    fingerprint is the root; sections and paragraphs hold node hashes, leaves
    the leaf hashes by section and paragraph. Null texts count as empty: no
    section, and the root of nothing. Repeated rows stay repeated.
    """
    tree = docs.select("doc_id", leaf_hashes(F.coalesce("text", F.lit(""))).alias("leaves"))
    return tree.select(
        "doc_id", root(F.col("leaves")).alias("fingerprint"), section_hashes(F.col("leaves")).alias("sections"),
        paragraph_hashes(F.col("leaves")).alias("paragraphs"), "leaves",
    )


def _leaf_rows(docs: DataFrame, tree: str) -> DataFrame:
    """doc, section, paragraph, leaf, start, hash, nth, text: every leaf of docs(doc, <tree>), nth among equal leaves."""
    sections = docs.select("doc", F.posexplode(tree).alias("section", "s"))
    paragraphs = sections.select("doc", "section", F.posexplode("s").alias("paragraph", "p"))
    rows = paragraphs.select("doc", "section", "paragraph", F.posexplode("p").alias("leaf", "text"))
    place = ("section", "paragraph", "leaf")
    before = Window.partitionBy("doc").orderBy(*place)
    return rows.withColumn("hash", F.substring(F.sha2("text", 256), 1, 16)).select(
        "doc", *place, "text", "hash",
        (F.sum(F.length("text")).over(before) - F.length("text")).cast("long").alias("start"),
        F.row_number().over(Window.partitionBy("doc", "hash").orderBy(*place)).alias("nth"),
        F.row_number().over(before).alias("at"),
    )


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, change, section, paragraph, leaf, start, old_start, text: where two versions of a text differ.

    Documents of both tables are compared by doc_id; where the roots are equal
    nothing is. Of the others the leaves are aligned by hash and occurrence
    number: the second of two equal leaves meets the second one of the other
    version. `added` leaves are only in `after`, `deleted` ones only in `before`
    (their places are those in `before`, start is null). `moved` is a leaf of
    both whose neighbour before it, among the leaves of both, is another one
    than in `before`: there begins a run that was moved, or one from the front
    of which something was moved away. start and old_start are character
    positions in the new and the old text.

    Null texts are empty. Rows that repeat a doc_id are numbered by their texts
    in both tables and compared number by number; rows without a partner give
    nothing, a null doc_id is an id like others. Equal or empty tables give an
    empty table.
    """

    def versions(docs: DataFrame, name: str) -> DataFrame:
        rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        return rows.select(
            F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), nth.alias("nth")).alias("doc"),
            F.col("doc_id"), leaves(F.col("text")).alias(name), root(leaf_hashes(F.col("text"))).alias(f"{name}_root"),
        )

    pair = versions(before, "old").join(versions(after, "new").drop("doc_id"), "doc").filter("old_root <> new_root")
    old = _leaf_rows(pair.select("doc", "old"), "old")
    new = _leaf_rows(pair.select("doc", "new"), "new")
    place = ("section", "paragraph", "leaf", "start", "text", "at")
    key = ["doc", "hash", "nth"]
    both = new.join(old.select(*key, *(F.col(c).alias(f"old_{c}") for c in place)), key, "full")
    # the order among leaves of both versions; the first of them has no neighbour in either
    kept = Window.partitionBy("doc", F.col("at").isNotNull() & F.col("old_at").isNotNull())
    ranked = both.withColumn("rank", F.row_number().over(kept.orderBy("old_at", "at")))
    follows = F.coalesce(F.lag("rank").over(kept.orderBy("at", "old_at")), F.lit(0)) == F.col("rank") - 1
    change = F.when(F.col("old_at").isNull(), "added").when(F.col("at").isNull(), "deleted").when(~follows, "moved")
    told = ranked.withColumn("change", change).filter("change is not null")
    ids = pair.select("doc", "doc_id")
    return told.join(ids, "doc").select(
        "doc_id", "change", *(F.coalesce(c, f"old_{c}").alias(c) for c in ("section", "paragraph", "leaf")),
        "start", "old_start", F.coalesce("text", "old_text").alias("text"),
    )


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, next_text: next is the following row by (doc_id, text), the first after the last.

    Nulls count as empty texts and come last as ids. Rows are dealt into ranges
    of doc_id by approximate quantiles; each range gets a copy of the first row
    of the range after it, so no task sees more than its range.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        array = F.array(*(F.lit(c) for c in cuts))
        bucket = F.aggregate(array, F.lit(0), lambda n, c: n + F.when(F.col("doc_id") > c, 1).otherwise(0))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(bucket))
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    # at most one row per bucket; the id of the null bucket is null
    first = {b: d for b, d in heads.collect()}
    ids = [d for d in first.values() if d is not None]
    wanted = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if None in first.values():
        wanted = wanted | F.col("doc_id").isNull()
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    moved = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    copies = rows.filter(wanted).groupBy("bucket").agg(F.min("text").alias("text")).select(
        F.lit(None).cast("long").alias("doc_id"), "text", moved[F.col("bucket")].alias("bucket"), F.lit(1).alias("copy")
    )
    along = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    return rows.withColumn("copy", F.lit(0)).unionByName(copies).select(
        "doc_id", "text", "copy", F.lead("text").over(along).alias("next_text")
    ).filter("copy = 0").drop("copy")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by as
    many from the start of the next document, or all of it. One row per row;
    null texts count as empty; an empty table gives an empty table.
    """
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    three = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited")
    ).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        leaf_hashes(F.col("text")).alias("own"), leaf_hashes(F.col("edited")).alias("other"),
        flat(leaf_hashes(F.col("next_text"))).alias("next"),
    )
    return three.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("own")).alias("fingerprint"),
        root(F.col("other")).alias("edited_fingerprint"),
        flat(F.col("own")).alias("a"), flat(F.col("other")).alias("b"), "next",
    ).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"),
    )
