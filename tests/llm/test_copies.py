"""SimHash groups, repeated strings, decontamination and neighbours against brute force."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ann, decontam, simhash, suffixes
from docloom.llm.components import components
from docloom.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import sort_key


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_simhash_groups(edges, edge_rows, no_documents):
    got = simhash.near_groups(edges).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, got), key=sort_key) == sorted(brute.near_groups(pairs(edge_rows)), key=sort_key)
    assert simhash.near_groups(no_documents).count() == 0


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_simhash"][0](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_groups(pairs(rows)))


def test_covering_masks_miss_every_pattern():
    rng = random.Random(1)
    for radius in (1, 2, 3, 5):
        masks = simhash.covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            pattern = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & pattern for m in masks)


def test_links_of_crowded_buckets(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(3):
        center = rng.getrandbits(63)
        prints |= {center ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))) for _ in range(150)}
    want = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for hot in (4096, 5):
        got = {r.node: r.root for r in components(simhash.links(df, 3, hot)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_one_document_of_each_group_stays(edges, edge_rows):
    kept = simhash.without_near_copies(edges)
    assert kept.columns == edges.columns
    want = collections.Counter(first for _, first in {(root, first) for _, _, root, first in brute.near_roots(pairs(edge_rows))})
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


def test_similar_texts_leave_one(spark, edges, edge_rows, no_documents):
    kept = simhash.without_similar(edges)
    assert kept.columns == edges.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(brute.similar_first(pairs(edge_rows)))
    assert simhash.without_similar(no_documents).count() == 0


def test_near_copies_are_found_and_others_are_left(spark):
    rng = random.Random(9)

    def words(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)]

    rows, last = [], None
    for i in range(200):
        if i % 4 == 1:  # one word of the text before is another one
            last = last[:]
            last[rng.randrange(len(last))] = "changed"
        elif i % 4 == 2:  # half of it is other words
            last = last[: len(last) // 2] + words(len(last) // 2)
        else:
            last = words(rng.randrange(120, 400))
        rows.append((i, " ".join(last)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.without_similar(df).collect()}
    assert {i for i in range(200) if i % 4 != 1} <= kept
    assert len({i for i in range(200) if i % 4 == 1} & kept) <= 2


def test_similar_texts_of_one_template(spark):
    """Every text has its template's words, so all are candidates, but only planted copies are similar."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(160)]
    rows = []
    for _ in range(40):  # the same words in another order: equal fingerprints, no shingle in common
        mixed = rng.sample(words, len(words))
        rows += [" ".join(mixed), " ".join([*mixed, mixed[0]]), " ".join(mixed).upper()]
    for _ in range(40):  # every eighth word is one of the text's own
        own = [w if i % 8 else "".join(rng.choice("xyz") for _ in range(9)) for i, w in enumerate(words)]
        rows += [" ".join(own), " ".join([*own[:-1], "end"])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = sorted(brute.similar_first(rows, radius=64))
    assert len(want) == 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (simhash.BLOCK, 7):
        groups = simhash.similar_groups(df, block=block)
        assert sorted(r.component_id for r in groups.select("component_id").distinct().collect()) == want
    assert sorted(r.doc_id for r in simhash.without_similar(df).collect()) == want


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    nodes = rng.sample(range(10_000), 400)
    edges = [(a, b) for chain in (nodes[:250], nodes[250:]) for a, b in zip(chain, chain[1:])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: min(chain) for chain in (nodes[:250], nodes[250:]) for n in chain}


def test_repeated_strings(edges, edge_rows, no_documents):
    want = sorted(brute.unrepeated(pairs(edge_rows)), key=sort_key)
    for hot in (suffixes.HOT, 2):
        got = suffixes.without_repeats(edges, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got), key=sort_key) == want
    assert suffixes.without_repeats(no_documents).count() == 0


def test_repeated_strings_of_shared_passages(spark):
    rng = random.Random(5)

    def text(n):
        return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(n))

    shared = [text(60) for _ in range(5)] + [text(36), "a" * 400, "ab " * 130]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            parts.append(p[rng.randrange(0, len(p) // 2) : len(p) - rng.randrange(0, len(p) // 3)] + text(rng.randrange(0, 20)))
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute.unrepeated(rows)


def test_anchor_covers_every_string_once():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (199, 200, 700)] + [b"z" * 500, b"xyz" * 200]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    _, begin, stop, place, _, _ = suffixes.anchors(data, starts, ends)
    hashes = suffixes.Hashes(data, 0).every(suffixes.KMER)
    want = {s: s + int(hashes[s : s + suffixes.PLACES].argmin()) for a, b in zip(starts, ends) for s in range(a, b - suffixes.LENGTH + 1)}
    assert {s: p for a, b, p in zip(begin, stop, place) for s in range(a, b + 1)} == want


def test_contamination(spark, edges, edge_rows, no_documents):
    texts = dict(pairs(edge_rows))
    items = [
        (1, " ".join(texts[9].split()[3:20])),
        (2, texts[5].upper()),
        (2, texts[5]),
        (None, texts[10]),
        (3, None),
        (4, ""),
        (5, "34"),
        (6, " ".join(texts[12].split()[5000:5009])),
        (7, "nowhere at all"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(pairs(edge_rows), items), key=sort_key)
    for block in (decontam.BLOCK_BYTES, 600):
        found = decontam.with_matches(edges, benchmark, block_bytes=block)
        got = found.select("doc_id", "n_words", "n_hit", "item_ids").collect()
        assert sorted(map(tuple, got), key=sort_key) == want
        for r in found.filter("n_hit > 0").collect():
            assert sum(s.n_words for s in r.spans) == r.n_hit and r.longest <= max(s.n_words for s in r.spans)
    assert decontam.with_matches(no_documents, benchmark).count() == 0
    assert decontam.with_matches(edges, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_contamination_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = QUERIES["op7_decontamination"][0](spark, SF).collect()
    want = brute.contamination(pairs(rows), [tuple(r) for r in items])
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted((i, n, h, len(x)) for i, n, h, x in want)


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(400)]
    rows += [(i, rows[7][1], 1) for i in range(400, 470)]  # many copies of one vector
    rows += [(470, None, 1), (471, [0.0] * 16, 1), (472, [float("nan")] * 16, 1), (473, [None] + [1.0] * 15, None)]
    rows += [(474, [], 1), (None, rows[3][1], 1), (475, [float("inf")] * 16, 1), rows[9], (480, rows[10][1], 2)]
    return rows


def test_neighbours(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    for shard_values in (1 << 23, 400):
        got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, shard_values=shard_values).collect()
        by_query = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
        want = brute.neighbours({(i, tuple(v) if v else None) for i, v, _ in rows}, 10, 20)
        assert by_query.keys() == want.keys()
        shares = []
        for q, mine in by_query.items():
            assert len(mine) == 10 and mine == sorted(mine, key=lambda x: (-x[1], x[0])) and q not in dict(mine)
            shares.append(len(dict(mine).keys() & dict(want[q]).keys()) / 10)
        assert np.mean(shares) >= 0.9
        # Ties go to smaller ids.
        assert by_query[400] == [(i, s) for i, s in want[400]]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


def test_neighbours_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute.neighbours([tuple(r) for r in rows], 20, 20)
    got = {}
    for r in QUERIES["op6_neighbours"][0](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in near}) / 20 for q, near in want.items()]) >= 0.9


def test_neighbours_compute_products_of_probed_vectors_only():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 64)) * 4
    vectors = centres[rng.integers(0, 50, 20_000)] + rng.normal(size=(20_000, 64))
    asked = vectors[::50]
    index = ann.Index(ann.Coder(vectors[:4_096], 20), vectors)
    hits = 0
    for query, code in zip(asked, index.coder.codes(asked)):
        true = np.argsort(-(vectors @ query))[:20]
        found, score = index.nearest(query, code, 20)
        hits += len(set(true) & set(found[np.argsort(-score)[:20]]))
    assert hits / (20 * len(asked)) > 0.9
    assert index.products < len(asked) * len(vectors) / 4


def test_probing_finds_every_code_in_the_radius():
    vectors = np.random.default_rng(4).normal(size=(3_000, 64))
    index = ann.Index(ann.Coder(vectors, 20), vectors)
    for radius in (0, 1, 2, 3, 4, 7, 10, 22, 25, 64):
        for code in index.codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(index.codes ^ code) <= radius).tolist()
