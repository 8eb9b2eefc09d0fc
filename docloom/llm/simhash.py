"""Near duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is 1 in over half of the XXH64 hashes of the
text's word shingles. Fingerprints link if at most ``radius`` bits differ. To find all links, every
bit gets a non-zero vector of radius + 1 bits, and every non-zero vector v of that length makes a
table: its key keeps the bits whose vector has an odd product with v. The vectors of any ``radius``
bits leave some v orthogonal to all of them, so two fingerprints within the radius agree on the
whole key of that table: every link is found, by construction.

Equal fingerprints are one row before the tables are made. In a bucket, links are found by counting
bits and only links that span each connected part are returned, so a bucket yields fewer edges than
rows. A bucket of more than ``HOT`` different fingerprints is split by a second family of masks
over the bits that its key leaves open, which again covers all pairs; what shares both keys differs
in some 15 bits at most, so no bucket is beyond a task, however frequent a pattern is.

Edge cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a
shingle make one shingle; documents with a null id are in groups, but name none (a group without
any id has component null); repeated rows have equal results; an empty table gives an empty one.
Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.common import scratch, stored, text_runs
from docloom.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
# For groups by similarity: shingles of so many words, and how far apart candidates may be.
SIMILARITY = 0.8
WORDS = 5
WIDE_RADIUS = 5
HOT = 4_096
# A part of a cluster has at most about so many nodes and bytes of shingles.
BLOCK = 2_048
BLOCK_BYTES = 16 << 20
RUN_BYTES = 4 << 20
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, once: bool = False) -> int:
    """Words are runs of bytes that are no ASCII white space, A to Z lowered; with ``once`` a word
    that repeats counts once (for shingles of one word)."""
    words = text.lower().split()
    if not words:
        return 0
    if once:
        words = list(dict.fromkeys(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[min(shingle, len(words)) - 1 :] - 1
    first = np.concatenate(([0], ends))[: len(last)]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(last), CHUNK):
        cut = zip(first[a : a + CHUNK].tolist(), last[a : a + CHUNK].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in cut], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(last), bitorder="little").view("<u8")[0])


def with_fingerprints(documents: DataFrame, shingle: int = SHINGLE, name: str = "fp", keep: list[str] | None = None, once: bool = False) -> DataFrame:
    """Columns ``keep`` (None: all) of every row and its fingerprint as a signed 64-bit number."""
    kept = [c for c in (keep or documents.columns) if c != name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "text", RUN_BYTES):
                found = np.array([fingerprint(t, shingle, once) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found)], names=[*kept, name])

    schema = StructType([*documents.select(*kept).schema, StructField(name, LongType())])
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(add, schema)


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit places: any ``radius`` of the places miss one mask entirely."""
    top = 1 << (radius + 1)
    vector = {bit: 1 + i % (top - 1) for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links within the radius that span every connected part of one bucket's fingerprints: each
    fingerprint is linked once, to one that was reached before it."""
    reached: list[int] = []
    members: list[int] = []
    left = np.sort(prints)
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            parent = np.full(len(left), -1)
            for i in range(0, len(frontier), 256):
                rest = np.flatnonzero(parent < 0)
                near = np.bitwise_count((frontier[i : i + 256, None] ^ left[None, rest]).view(np.uint64)) <= radius
                hit = near.any(axis=0)
                parent[rest[hit]] = i + near[:, hit].argmax(axis=0)
            found = parent >= 0
            reached += frontier[parent[found]].tolist()
            frontier, left = left[found], left[~found]
            members += frontier.tolist()
    return reached, members


def _bucket_edges(radius: int, keys: int):
    """Edges from batches sorted by ``keys`` columns with the fingerprint behind them."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((keys + 1, 0), np.int64)

        def flushed(table: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((table[:-1, 1:] != table[:-1, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate(([0], change)), np.append(change, table.shape[1])
            prints, size = table[-1], ends - starts
            pairs = starts[size == 2]
            linked = pairs[np.bitwise_count((prints[pairs] ^ prints[pairs + 1]).view(np.uint64)) <= radius]
            us, vs = prints[linked].tolist(), prints[linked + 1].tolist()
            for a, b in zip(starts[size > 2], ends[size > 2]):
                reached, members = spanning_links(prints[a:b], radius)
                us += reached
                vs += members
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            table = np.hstack([rest, np.vstack([c.to_numpy() for c in batch.columns])])
            if not table.shape[1]:
                continue
            last = (table[:-1] == table[:-1, -1:]).all(axis=0)
            cut = table.shape[1] - (np.argmin(last[::-1]) if not last.all() else table.shape[1])
            if cut:
                yield flushed(table[:, :cut])
            rest = table[:, cut:]
        if rest.shape[1]:
            yield flushed(rest)

    return edges


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (different values of ``fp``) within the radius."""
    masks = covering_masks(radius, list(range(BITS)))
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "k"))
    counted = keyed.select(F.col("t").cast("long").alias("t"), "k", "fp").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("t", "k")))
    usual = counted.filter((F.col("_n") > 1) & (F.col("_n") <= hot)).select("t", "k", "fp").mapInArrow(_bucket_edges(radius, 2), "u long, v long")

    deeper = np.array([[m | x for x in covering_masks(radius, [b for b in range(BITS) if not m >> b & 1])] for m in masks], np.uint64).view(np.int64)

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = deeper.shape[1]
        for batch in batches:
            t, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [np.repeat(t, width), np.tile(np.arange(width), len(t)), (fp[:, None] & deeper[t]).ravel(), np.repeat(fp, width)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "t2", "k2", "fp"])

    split = (
        counted.filter(F.col("_n") > hot)
        .select("t", "fp")
        .mapInArrow(divided, "t long, t2 long, k2 long, fp long")
        .repartition("t", "t2", "k2")
        .sortWithinPartitions("t", "t2", "k2")
        .mapInArrow(_bucket_edges(radius, 3), "u long, v long")
    )
    return usual.union(split)


def near_groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    ``root`` names the group of linked fingerprints, ``component_id`` is the smallest id in it.
    """
    keep = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = stored(with_fingerprints(keep, shingle, keep=["doc_id", "text_hash"]), "fingerprints")
    different = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = components(links(different.select("fp"), radius, hot))
    rooted = different.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "fp", "root", "component_id")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted different hashes of the text's word shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    last = ends[min(words, len(found)) - 1 :] - 1
    first = np.concatenate(([0], ends))[: len(last)]
    digest, parts = xxhash.xxh64_intdigest, []
    for a in range(0, len(last), CHUNK):
        cut = zip(first[a : a + CHUNK].tolist(), last[a : a + CHUNK].tolist())
        parts.append(np.array([digest(joined[i:j], SEED) for i, j in cut], "<u8"))
    return np.unique(np.concatenate(parts))


def similar_links(
    prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, only: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Links that span each part of texts that hang together by links within the radius whose shingle
    sets have the similarity: places in the given, different sets.

    With ``only``, all links between these places and any other are returned instead.
    """
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    owners = np.repeat(np.arange(len(sets)), sizes)[order]
    begin = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    own = np.split(codes, np.cumsum(sizes)[:-1])
    reached: list[int] = []
    members: list[int] = []
    left = np.arange(len(sets))

    def similar_to(a: int, among: np.ndarray) -> np.ndarray:
        near = among[np.bitwise_count((prints[among] ^ prints[a]).view(np.uint64)) <= radius]
        if not len(near) or not sizes[a]:
            return near[:0]
        # Every shingle of the text names the texts that have it: these counts are the intersections.
        with_it = [owners[i:j] for i, j in zip(begin[own[a]].tolist(), begin[own[a] + 1].tolist())]
        both = np.bincount(np.concatenate(with_it), minlength=len(sets))[near]
        return near[both / (sizes[a] + sizes[near] - both) >= similarity]

    if only is not None:
        for a in only.tolist():
            found = similar_to(a, left[left != a])
            reached += [a] * len(found)
            members += found.tolist()
        return reached, members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            found = similar_to(a, left)
            reached += [int(a)] * len(found)
            members += found.tolist()
            frontier += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return reached, members


def _confirmed(radius: int, similarity: float):
    """Edges from batches sorted by (cluster, i, j) with node, fp, other, shingles and open behind them.

    A group without open nodes is searched whole; else only pairs with an open node are wanted.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def linked() -> tuple[list[int], list[int]]:
            if len(held) < 2:
                return [], []
            nodes, rows = list(held), list(held.values())
            prints, sets, awaited = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows])
            reached, members = similar_links(prints, sets, radius, similarity, np.flatnonzero(awaited) if awaited.any() else None)
            return [nodes[i] for i in reached], [nodes[i] for i in members]

        def batch_of(us: list[int], vs: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            us, vs = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "fp", "shingles", "open")))
            for here, (node, fp, shingles, awaited) in zip(keys, rows):
                if here != key:
                    a, b = linked()
                    us += a
                    vs += b
                    key, held = here, {}
                # A node that comes twice is the same set.
                held[node] = (fp, np.frombuffer(shingles, "<u8"), awaited)
            yield batch_of(us, vs)
        yield batch_of(*linked())

    return edges


def _candidate_groups(prints: DataFrame, radius: int) -> DataFrame:
    """(node, cluster) of nodes whose fingerprints hang together by links within the radius."""
    near = components(links(prints.select("fp").distinct(), radius)).select(F.col("node").alias("_fp"), F.col("root").alias("cluster"))
    return prints.join(near, F.col("fp") == F.col("_fp"), "left").select("node", "fp", "size", "one", F.coalesce("cluster", "fp").alias("cluster"))


def similar_groups(
    documents: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = WIDE_RADIUS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, text_hash, root, component_id): groups of texts whose shingles of ``words`` words have
    a Jaccard similarity of at least ``similarity``.

    Candidates are all pairs of texts whose fingerprints of the different words are within the wider
    ``radius``; these move less under an edit than those of longer shingles. Texts with equal sets of
    shingles are one node. The nodes of fingerprints that hang together by links within the radius are
    a cluster, which holds every candidate pair of its nodes. A cluster is searched with its sets of
    shingles at hand, so a pair links only if it is within the radius and similar.

    A cluster of more than ``block`` nodes or ``BLOCK_BYTES`` of shingles is dealt into parts twice, by
    two hashes of the node. Links that span the parts join nearly all nodes that hang together. Then
    the nodes outside the cluster's largest joined group are open: they are cut into blocks, and each
    block meets every part, so every pair that is not joined yet is tested, and no task grows with the
    cluster. Sets of shingles move twice, and once per block of open nodes, not once per part.
    """
    spark = documents.sparkSession
    keep = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_runs(batch, "text", RUN_BYTES):
                prints = np.array([fingerprint(t, 1, True) for t in some], np.uint64).view(np.int64)
                sets = [shingle_set(t, words) for t in some]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(prints), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "node", "size"])

    placed_columns = ["cluster", "node", "fp", "parts"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_runs(batch, "text", RUN_BYTES):
                sets = [shingle_set(t, words).tobytes() for t in some]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in placed_columns), pa.array(sets, pa.binary())], names=[*placed_columns, "shingles"])

    added = [StructField(c, LongType()) for c in ("fp", "node", "size")]
    schema = StructType([*keep.select("doc_id", "text_hash").schema, *added])
    prints = stored(keep.mapInArrow(sketched, schema), "fingerprints")
    with scratch(spark) as held:
        texts = prints.groupBy("node", "fp").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.min(F.struct("text_hash", "doc_id")).alias("one"))
        texts = held(texts, "texts")
        placed = _candidate_groups(texts, radius)
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") * 8 / BLOCK_BYTES), F.lit(1))
        clusters = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).filter("n > 1").select(F.col("cluster").alias("_cluster"), "parts")
        members = placed.join(clusters, F.col("cluster") == F.col("_cluster")).select("node", "fp", "one", "cluster", "parts")
        # One document of each node in a cluster gives its shingles; the cluster travels with its id.
        wanted = members.select(*placed_columns, F.col("one.text_hash").alias("_hash"), F.col("one.doc_id").alias("_id"))
        sources = keep.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*placed_columns, "text")
        sets = held(sources.mapInArrow(shingled, "cluster long, node long, fp long, parts long, shingles binary"), "shingles")

        def tested(dealt: DataFrame) -> DataFrame:
            ordered = dealt.select("cluster", "i", "j", "node", "fp", "shingles", "open").repartition("cluster", "i", "j")
            return ordered.sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirmed(radius, similarity), "u long, v long")

        def by_hash(turn: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(turn), F.col("node")), F.col("parts"))

        def turn(number: int) -> Column:
            return F.struct(F.lit(number).cast("long").alias("i"), by_hash(number).alias("j"))

        turns = F.explode(F.when(F.col("parts") == 1, F.array(turn(0))).otherwise(F.array(turn(0), turn(1)))).alias("m")
        first_links = held(tested(sets.select("*", turns).select("*", "m.*", F.lit(False).alias("open"))), "first-links")
        large = sets.filter("parts > 1")
        found = first_links
        if not large.isEmpty():
            joined = held(components(first_links).select(F.col("node").alias("_node"), "root"), "joined")
            rooted = large.select("cluster", "node", "fp", "parts").join(joined, F.col("node") == F.col("_node"), "left").select("cluster", "node", "fp", "parts", F.coalesce("root", "node").alias("root"))
            sizes = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("left_out"))
            largest = largest.filter("left_out > 0").select(F.col("cluster").alias("_c"), "main", F.ceil(F.col("left_out") / block).alias("blocks"))
            # Nodes of clusters that are not one group yet: each meets the open nodes, block by block.
            waiting = rooted.join(largest, F.col("cluster") == F.col("_c")).select(F.col("node").alias("_n"), F.col("cluster").alias("_c"), "blocks", (F.col("root") != F.col("main")).alias("open"))
            again = large.join(waiting, (F.col("node") == F.col("_n")) & (F.col("cluster") == F.col("_c")))
            part, own = by_hash(2), F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col("blocks"))
            steps = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
            everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(own.alias("i"), x.alias("j"), F.lit(True).alias("open")))
            once = F.transform(steps, lambda x: F.struct(x.alias("i"), part.alias("j"), F.lit(False).alias("open")))
            # An open node stands in its part for the other blocks too, where it is an ordinary one.
            among = F.filter(once, lambda s: s["i"] != own)
            meets = F.explode(F.when(F.col("open"), F.concat(everywhere, among)).otherwise(once)).alias("m")
            found = first_links.union(tested(again.select("cluster", "node", "fp", "shingles", meets).select("cluster", "node", "fp", "shingles", "m.*")))
        similar = components(found).withColumnRenamed("node", "_node")
        rooted = texts.join(similar, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = stored(rooted.join(smallest, "root").select(F.col("node").alias("_named"), "root", "component_id"), "groups")
    return prints.join(named, F.col("node") == F.col("_named")).select("doc_id", "text_hash", "root", "component_id")


def one_of_each(documents: DataFrame, groups: DataFrame, text_hash) -> DataFrame:
    """``documents`` with one row of each group: the one with the smallest id; among rows that
    repeat this id the smallest hash of the text decides, and of equal rows one stays."""
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Only rows that bear their group's smallest id get here, so a large group is few rows.
    one = first.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    kept = one.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = documents.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash"))).drop("_id", "_hash")
    number = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(F.lit(1)))
    return rows.withColumn("_number", number).filter("_number = 1").drop("_number")


def without_near_copies(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of ``near_groups``."""
    return one_of_each(documents, near_groups(documents, shingle, radius), F.xxhash64("text"))


def without_similar(documents: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each group of ``similar_groups``."""
    groups = similar_groups(documents, similarity, words, radius)
    return one_of_each(documents, groups, F.xxhash64(F.coalesce("text", F.lit(""))))
