"""Similarity join of documents on the Jaccard index of their word shingles.

Method: size-banded tiles with hashed bitmap signatures. Documents of which
the first shingles (in one global order) meet in a key form the tiles of that
key, ordered by set size; a tile pair is compared only where the sizes allow
the similarity, by bit counts of bitmaps, which bound the overlap from above.
What passes is intersected exactly on sorted arrays.

What keeps it whole: two sets with J >= t share at least one of their first
n - ceil(t n) + 1 shingles in any common order, so no link is missed.

What keeps it small:
* documents with equal sets are one representative from the start;
* the order puts shingles that a large share of the documents holds last, so a
  common passage does not become a common key (the order affects only speed);
* representatives are first linked to leaders of their least shingles by exact
  comparison, in a few rounds with other leaders, and only pairs of different
  clusters go on: a group of near copies costs a linear number of comparisons,
  not all its pairs;
* a pair belongs to the first key both share, so the places of the key in both
  prefixes bound its overlap too, and narrow the size band of a document;
* that key is looked up, too: a tile knows the first EARLIER tiles before it of
  each document and leaves a pair that met in one of them to it;
* a document without one of another cluster in its size band of a tile is not in it;
* the documents of a key are cut into blocks of about BLOCK in the order of their
  sizes (one size that more of them hold, by a hash inside that size), and a
  document goes only to the block pairs whose sizes its own allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import mixed, pieces, saved
from pixelloom.llm.components import components
from pixelloom.llm.words import shingles, words_of

BLOCK = 512
COMMON_SHARE = 256  # a shingle in more than 1 / COMMON_SHARE of the documents goes last
SURVEY_ROWS = 2048
FILTER_BITS = 1 << 24
EARLIER = 16  # a pair without a common one among them is compared again, and dropped as repeated
LEADER_KEYS = 4
LEADER_TURNS = 6
WIDEST = 1 << 16

SURVEYED = "kind int, a long, b long, c long, n int"
FEATURES = "doc_id long, n_shingles int, least array<long>, prefix array<long>, bits binary"


def classes(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs(doc_id, text).

    Two documents are linked when 100 |A and B| >= percent |A or B| for their
    sets of k-word shingles (words [^ \\t-\\r]+, A-Z lower-cased); component_id
    is the smallest doc_id reachable by links. Null, empty and blank texts have
    no shingles and link with nothing; a row without doc_id keeps its count and
    gets a null component. Rows that repeat a doc_id are one node of the graph
    and stay rows of their own. Other columns of docs are ignored. An empty
    table gives an empty table. Shingles are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _row_classes(docs, percent, k)
    # rows are compared by a number of their own (written, so it stays), then the rows of a doc_id are joined
    rows = saved(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    grouped = saved(_row_classes(rows.select(F.col("row").alias("doc_id"), "text"), percent, k), "row-classes")
    ids = rows.filter("row is not null").select("row", "doc_id")
    named = grouped.select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(ids, "row", "left")
    first = ids.select(F.col("row").alias("component_id"), F.col("doc_id").alias("b"))
    links = named.filter("row <> component_id").select(F.col("doc_id").alias("a"), "component_id").join(first, "component_id")
    found = components(links.select("a", "b"))
    return named.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _row_classes(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """classes() where no doc_id is on two rows."""
    survey = saved(docs.mapInArrow(_survey(k), SURVEYED), "survey")
    common = common_shingles(survey)
    sizes = survey.filter("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("d1"), F.col("c").alias("d2"), F.col("n").alias("n_shingles"))
    known = sizes.filter("doc_id is not null and n_shingles > 0")
    least = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = known.join(least, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = saved(copies.filter("a <> b").distinct(), "copies")
    features = docs.filter("doc_id is not null").mapInArrow(_features(common, percent, k), FEATURES)
    reps = saved(
        features.join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti"), "representatives"
    )
    clusters = saved(components(_led(docs, reps, percent, k)), "clusters")
    crossing = saved(_tile_pairs(reps, clusters, percent), "pairs")
    crossing = verified(crossing, sets_of(docs, _ids(crossing), k), percent)
    links = copies.unionByName(clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(crossing)
    found = components(links)
    return sizes.select("doc_id", "n_shingles").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def distinct_runs(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = np.sort(hashes[a:b])
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own


def _survey(k: int):
    """Of each run of about SURVEY_ROWS documents: frequent shingles (kind 0: key, documents), its documents (kind 1:
    doc_id, set digest in two parts, set size) and their number (kind 2)."""

    def run(batches):
        for batch in batches:
            runs, rows, left = [], 0, batch.num_rows
            for part, buf, at in pieces(batch):
                rows += part.num_rows
                left -= part.num_rows
                own = list(distinct_runs(*shingles(words_of(buf, at), k)))
                runs.extend(own)
                d1 = [int(mixed(x).sum(dtype=np.uint64).astype(np.int64)) for x in own]
                d2 = [int(mixed(x ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)) for x in own]
                yield _surveyed(1, part.column(0).cast(pa.int64()), d1, d2, [len(x) for x in own])
                if rows >= SURVEY_ROWS or not left:
                    keys, n = np.unique(np.concatenate(runs), return_counts=True)
                    often = n >= max(2, rows / COMMON_SHARE)
                    yield _surveyed(0, keys[often].view(np.int64), n[often], [0] * int(often.sum()), [0] * int(often.sum()))
                    yield _surveyed(2, [0], [rows], [0], [0])
                    runs, rows = [], 0

    return run


def _surveyed(kind: int, a, b, c, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32())],
        names=["kind", "a", "b", "c", "n"],
    )


def common_shingles(survey: DataFrame) -> np.ndarray:
    """Shingles in more than 1 / COMMON_SHARE of the documents, by counts over all of them.

    A shingle with such a share has it in at least one batch, so every batch
    reports only those; at most COMMON_SHARE times the mean set size can pass.
    """
    rows = survey.filter("kind = 2").agg(F.sum("b")).first()[0] or 0
    totals = survey.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    often = totals.filter(F.col("n") * COMMON_SHARE > rows).select("a").toArrow()
    return np.sort(often.column("a").to_numpy().astype(np.int64).view(np.uint64))


def bitmap_bits(n: int) -> int:
    """Bits of the signature of a set of n: four times its size or more, as a power of two."""
    return min(WIDEST, max(64, 1 << int(4 * n - 1).bit_length()))


def _features(common: np.ndarray, percent: int, k: int):
    """Size, first shingles and bitmap of every document that has shingles."""

    def run(batches):
        for batch in batches:
            for part, buf, at in pieces(batch):
                ids, size, least, prefix, bits = part.column(0).to_numpy(zero_copy_only=False), [], [], [], []
                for own in distinct_runs(*shingles(words_of(buf, at), k)):
                    n = len(own)
                    size.append(n)
                    if not n:
                        continue
                    keep = n - (percent * n + 99) // 100 + 1
                    late = np.isin(own, common) if len(common) else None
                    first = own if late is None or not late.any() else np.concatenate([own[~late], own[late]])
                    least.append(own[:LEADER_KEYS].view(np.int64))
                    prefix.append(first[:keep].view(np.int64))
                    width = bitmap_bits(n)
                    signature = np.zeros(width, np.uint8)
                    signature[(mixed(own) & np.uint64(width - 1)).astype(np.int64)] = 1
                    bits.append(np.packbits(signature).tobytes())
                some = np.array(size) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some].astype(np.int64)), pa.array(np.array(size)[some], pa.int32()),
                     pa.array(least, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "least", "prefix", "bits"],
                )

    return run


def _sizes_allow(percent: int, a: str = "na", b: str = "nb"):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _led(docs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between representatives and leaders of their least shingles, exactly compared.

    Each of the least shingles of a set is a key, and every key names one leader
    per turn by a hash. A document is compared with its leaders, if sizes and bit
    counts allow it, and only while they are not known to be linked: a linear
    number of pairs, after which groups of near copies have few clusters left.
    """
    rows = reps.select("doc_id", F.explode("least").alias("key"))
    leaders = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *(F.min_by("doc_id", F.xxhash64(F.lit(t), "doc_id")).alias(f"lead{t}") for t in range(LEADER_TURNS))
    ).filter("n > 1").drop("n")
    met = rows.join(leaders, "key").select(
        "doc_id", F.posexplode(F.array(*(f"lead{t}" for t in range(LEADER_TURNS)))).alias("turn", "lead")
    ).filter("doc_id <> lead").groupBy(F.greatest("doc_id", "lead").alias("a"), F.least("doc_id", "lead").alias("b")).agg(F.min("turn").alias("turn"))
    for side in ("a", "b"):
        met = met.join(reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}")), side)
    met = met.filter(_sizes_allow(percent))
    for side, name in (("a", "x"), ("b", "y")):
        met = met.join(reps.select(F.col("doc_id").alias(side), F.col("bits").alias(name)), side)
    signed = met.select("a", "b", "turn", "na", "nb", "x", "y")
    allowed = saved(signed.mapInArrow(_bounded(percent), "a long, b long, turn int"), "leaders")
    sets = sets_of(docs, _ids(allowed), k)
    links, labels = None, None
    for turn in range(LEADER_TURNS):
        pairs = allowed.filter(F.col("turn") == turn).select("a", "b")
        if labels is not None:
            pairs = pairs.join(labels.select(F.col("doc_id").alias("a"), F.col("label").alias("la")), "a", "left").join(
                labels.select(F.col("doc_id").alias("b"), F.col("label").alias("lb")), "b", "left"
            ).filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
            pairs = saved(pairs, "turn")  # with a known size, few pairs need no shuffle of the sets
        found = saved(verified(pairs, sets, percent), "led")
        links = found if links is None else links.unionByName(found)
        # the least document at the other end of a link, enough to save comparisons
        labels = links.select(F.col("a").alias("doc_id"), F.col("b").alias("label")).unionByName(
            links.select(F.col("b").alias("doc_id"), F.col("b").alias("label"))
        ).groupBy("doc_id").agg(F.min("label").alias("label"))
    return links


def _bounded(percent: int):
    """Pairs (a, b, turn) whose bit counts allow the similarity."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            left, right, ok = batch.column(5), batch.column(6), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint8) for c in (left, right))
                x, y = fold_to(x, min(len(x), len(y))), fold_to(y, min(len(x), len(y)))
                most = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum()))
                ok[i] = (100 + percent) * most >= percent * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(3)], names=["a", "b", "turn"])

    return run


def _tile_pairs(reps: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different clusters that share a key and pass the size and bit-count bounds."""
    keyed = reps.select("doc_id", F.explode("prefix").alias("key"))
    twice = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("key")
    twice = saved(twice, "keys")
    wanted = value_filter(twice, F.col("key"))
    met = reps.select("doc_id", "n_shingles", "prefix").mapInArrow(_filtered(wanted), "doc_id long, n_shingles int, key long, place int")
    met = met.join(twice, "key").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", "n_shingles", "place", F.coalesce("component", "doc_id").alias("cluster")
    )
    met = saved(met, "met")
    # of keys with the same documents the first in the common order is enough: they make the same tile
    tiles = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high"),
        F.sum(F.xxhash64("doc_id", "n_shingles").cast("decimal(38,0)")).alias("members"),
        F.min(F.struct("doc_id", "place"))["place"].alias("turn"),
    ).filter("low <> high").groupBy("n", "members").agg(F.min_by("key", "turn").alias("key")).select("key")
    met = met.join(tiles, "key")
    # a document without another of its size band in the tile has no pair there, so needs no bitmap
    met = met.withColumn("room", _room(F.col("n_shingles").cast("long"), F.col("place"), percent))
    size = F.col("n_shingles").cast("long") * percent
    met = met.join(_neighbour_sizes(met, percent), ["key", "n_shingles"])
    band = (F.col("below") >= size) | (F.col("room") >= F.col("above") * percent) | ((F.col("alike") > 1) & (F.col("room") >= size))
    foreign = (F.col("lowest") != F.col("cluster")) | (F.col("highest") != F.col("cluster"))
    # the tiles of a document in the common order: each tile gets the first of those before it
    own = met.filter(band & foreign).groupBy("doc_id", "n_shingles", "cluster").agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "room", "first_block", "last_block", "from_block", "to_block"))).alias("own")
    )
    met = own.join(reps.select("doc_id", "n_shingles", "bits"), ["doc_id", "n_shingles"]).select(
        "doc_id", "n_shingles", "cluster", "bits", F.slice("own.key", 1, EARLIER).alias("first"), F.posexplode("own").alias("turn", "tile")
    ).select(
        "doc_id", "n_shingles", "cluster", "bits", "tile.key", "tile.room", "tile.first_block", "tile.last_block", "tile.from_block", "tile.to_block",
        F.slice("first", F.lit(1), F.least(F.col("turn"), F.lit(EARLIER))).alias("earlier"),
    )
    # a row goes to the block pairs of its block and those of the sizes in its band, in either order alike
    spread = F.pmod(F.xxhash64("doc_id"), F.col("last_block") - F.col("first_block") + 1)
    cells = met.withColumn("block", (F.col("first_block") + spread).cast("int")).withColumn(
        "other", F.explode(F.sequence("from_block", "to_block"))
    ).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "doc_id", "cluster", "n_shingles", "room", "bits", "earlier",
    )
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n_shingles")
    return dealt.mapInArrow(_tiles(percent), "a long, b long").distinct()


def _room(size, place, percent: int):
    """The largest size of a partner, times percent, if the first common key lies at this place of the prefix.

    The overlap is at most size - place, and 100 overlap >= percent * union.
    """
    return (100 + percent) * (size - place) - percent * size


def _neighbour_sizes(met: DataFrame, percent: int) -> DataFrame:
    """Of each key and set size: documents of that size (alike), the widest room of smaller ones (below), the next size
    (above), the lowest and highest cluster among the sizes that allow the similarity, the first and last block of this
    size and of those sizes (from, to). A block number counts BLOCK documents in the order of their sizes.

    The rows of a key are summed by size before its window, so a key that very
    many documents share brings one row per size to a task.
    """
    along = Window.partitionBy("key").orderBy("n_shingles")
    # the range is a ratio of sizes, so it is taken on their logarithm (in millionths, one more on each end)
    reach = math.ceil(1e6 * math.log(100 / percent)) + 1
    near = Window.partitionBy("key").orderBy(F.round(F.log("n_shingles") * 1e6).cast("long")).rangeBetween(-reach, reach)
    sizes = met.groupBy("key", "n_shingles").agg(
        F.count(F.lit(1)).alias("alike"), F.max("room").alias("widest"), F.min("cluster").alias("low"), F.max("cluster").alias("high")
    ).withColumn("until", F.sum("alike").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumns({
        "first_block": F.floor((F.col("until") - F.col("alike")) / BLOCK).cast("int"),
        "last_block": F.floor((F.col("until") - 1) / BLOCK).cast("int"),
    })
    return sizes.select(
        "key", "n_shingles", "alike", F.min("low").over(near).alias("lowest"), F.max("high").over(near).alias("highest"),
        F.max("widest").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
        F.lead("n_shingles").over(along).cast("long").alias("above"), "first_block", "last_block",
        F.min("first_block").over(near).alias("from_block"), F.max("last_block").over(near).alias("to_block"),
    )


def _tiles(percent: int):
    """Compare the members of each (key, i, j), which lie together in the stream."""

    def cut(held: pa.Table):
        at = [held.column(c).to_numpy() for c in ("key", "i", "j")]
        changed = np.flatnonzero((at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]) | (at[2][1:] != at[2][:-1])) + 1
        return changed

    def compare(tile: pa.Table):
        ids, cluster, size, block, room = (tile.column(c).to_numpy() for c in ("doc_id", "cluster", "n_shingles", "block", "room"))
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        if cluster.min() == cluster.max():
            return
        bits = [np.frombuffer(x, np.uint8) for x in tile.column("bits").to_pylist()]
        limit = np.searchsorted(size, room // percent, "right")  # sorted by size
        earlier = tile.column("earlier").combine_chunks()
        at = np.append(0, np.cumsum(earlier.value_lengths().to_numpy(zero_copy_only=False)))
        names, codes = np.unique(earlier.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        width = np.array([len(x) for x in bits])
        stacks = {w: np.stack([fold_to(bits[x], w) for x in np.flatnonzero((width == w) | (width == 2 * w))]) for w in np.unique(width)}
        place = {w: np.cumsum((width == w) | (width == 2 * w)) - 1 for w in stacks}
        for x in range(len(ids) - 1):
            others = np.arange(x + 1, limit[x])
            others = others[(cluster[others] != cluster[x]) & (room[others] >= percent * int(size[x]))]
            if i != j:
                others = others[block[others] != block[x]]
            if len(others) and at[x] < at[x + 1]:  # a pair that also meets in an earlier tile is compared there
                before = np.zeros(len(names), bool)
                before[codes[at[x] : at[x + 1]]] = True
                met = np.append(0, np.cumsum(before[codes]))
                others = others[met[at[others + 1]] == met[at[others]]]
            if not len(others):
                continue
            w = width[x]
            stack = stacks[w]
            own, theirs = stack[place[w][x]], stack[place[w][others]]
            mine = size[x] - np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
            rest = size[others] - np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64)
            good = others[(100 + percent) * np.minimum(mine, rest) >= percent * (size[x] + size[others].astype(np.int64))]
            if len(good):
                yield np.maximum(ids[x], ids[good]), np.minimum(ids[x], ids[good])

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            marks = cut(held)
            if len(marks):
                done, held = held.slice(0, marks[-1]), held.slice(marks[-1])
                yield from pairs_of(done, marks[:-1])
        if held is not None and held.num_rows:
            yield from pairs_of(held, cut(held))

    def pairs_of(table: pa.Table, marks: np.ndarray):
        table = table.combine_chunks()
        edges = [0, *marks.tolist(), table.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            found = list(compare(table.slice(a, b - a))) if b - a > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["a", "b"],
                )

    return run


def fold_to(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of twice the width, halves laid over each other (low bits choose the place)."""
    return bits if len(bits) == width else bits[:width] | bits[width:]


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set): the sorted shingle arrays of the documents with these ids."""
    wanted = value_filter(ids, F.col("doc_id"))

    def arrays(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
            for part, buf, at in pieces(batch):
                sets = [own.tobytes() for own in distinct_runs(*shingles(words_of(buf, at), k))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    sets = docs.filter("doc_id is not null").mapInArrow(arrays, "doc_id long, set binary")
    return saved(sets.join(ids, "doc_id", "left_semi"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold, by intersection of their sorted shingle arrays."""

    def intersect(batches):
        for batch in batches:
            left, right, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(kept)) for i in range(2)], names=["a", "b"])

    def side(name, value):
        own = sets.select(F.col("doc_id").alias(name), F.col("set").alias(value))
        return own.join(pairs.select(name), name, "left_semi")

    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long").distinct()


def value_filter(rows: DataFrame, value) -> np.ndarray:
    """A bitmap of FILTER_BITS bits (2 MB at any size) over the low bits of the values.

    It only spares work: values that pass by chance are dropped by the join.
    """
    place = F.pmod(value, F.lit(FILTER_BITS)) + 1
    pages = rows.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for page, bits in pages.collect():
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
    return out


def in_filter(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.int64) & (FILTER_BITS - 1)
    return (bitmap[place >> 3] >> (place & 7) & 1).astype(bool)


def _filtered(wanted: np.ndarray):
    """Rows (doc_id, n_shingles, key, place in the prefix) of the keys that pass the bitmap."""

    def run(batches):
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            lists = batch.column(2)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            hit = in_filter(wanted, keys)
            take = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(keys[hit]), pa.array(place[hit].astype(np.int32))],
                names=["doc_id", "n_shingles", "key", "place"],
            )

    return run
