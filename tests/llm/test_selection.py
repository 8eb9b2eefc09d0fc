"""Hard negatives, fingerprints and importance resampling against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docloom.llm import fingerprints, importance, negatives
from docloom.llm.queries import QUERIES
from docloom.llm.ranges import with_following
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import sort_key


def mined(rows, is_anchor, positives=5, negative=5, low=80, high=100):
    """rows: id -> (label, whole numbers)"""
    out = []
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in rows.items() if i != a]
        for s, p, _ in sorted(x for x in scores if x[2] == label)[:positives]:
            able = sorted(x for x in scores if x[2] != label and low * -s <= high * -x[0] <= high * -s)
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(able[:negative])]
    return sorted(out)


def vectors(seed, n, size=8, scale=40):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [int(x) for x in rng.normal(size=size) * scale + 10], int(rng.integers(0, 4))) for i in rng.permutation(n * 3)[:n]]
    return rows + [(n * 3 + i, rows[0][1], int(rng.integers(0, 4))) for i in range(60)] + [(n * 3 + 60, [0] * size, 1)]


def test_hard_negatives(spark):
    for seed, scale, options in ((1, 40, {}), (2, 40, {"shard": 50, "clusters": 3, "sample": 10}), (3, 3_000_000, {"clusters": 5})):
        rows = vectors(seed, 500, scale=scale)
        df = spark.createDataFrame(rows, "vec_id long, v array<long>, label long").repartition(5)
        want = mined({i: (label, v) for i, v, label in rows}, lambda i: i % 20 == 0)
        got = negatives.mine(df, F.col("vec_id") % 20 == 0, **options)
        assert sorted(map(tuple, got.collect())) == want and want


def test_hard_negatives_walk_stops_early():
    """Of clustered rows an anchor sees only those near it, and the answer is the same."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 200
    rows = np.floor(centres[np.repeat(np.arange(20), 400)] + rng.normal(size=(8000, 16)) * 4).astype(np.int64)
    shard = negatives.Shard(np.arange(8000), np.zeros(8000, np.int64), rows)
    seen, plain = [], shard.scores
    shard.scores = lambda r, a: (seen.append(len(r) * len(a)), plain(r, a))[1]
    asked = shard.whole[:50]
    direction = negatives._unit(asked.sum(axis=0, keepdims=True).astype(float))[0]
    wide = float(negatives._angles(negatives._unit(asked.astype(float)), direction).max())
    order, bound = shard.listed(0, direction, wide)
    has, found, _ = shard.walk(order, bound, shard.ids[:50], None, asked, None, None, 5)
    exact = rows @ asked.T
    for j in range(50):
        want = sorted((-exact[i, j], i) for i in range(8000) if i != shard.ids[j])[:5]
        assert has[:, j].all() and [i for _, i in want] == found[:, j, 0].tolist()
    assert sum(seen) < 8000 * 50 / 4


def test_hard_negatives_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1, "x"), (1, [1.0, 2.5], 1, "x"), (2, [1.0, 2.4], 2, "x"), (2, [1.0, 2.4], 2, "x"), (2, [0.0, 9.0], 3, "x"),
        (3, None, 1, "x"), (4, [nan, 1.0], 1, "x"), (5, [None, 1.0], 2, "x"), (6, [inf, 1.0], 1, "x"), (7, [1.0], 1, "x"),
        (8, [], 1, "x"), (None, [1.0, 2.0], 2, "x"), (9, [1.0, 1.9], None, "x"), (10, [1.0, 2.45], 2, "x"), (11, [1.0, 2.45], 2, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, shard string")
    whole = F.transform("embedding", lambda x: F.floor(256 * x))
    usable = negatives.usable(df, whole, F.col("label"))
    keep = {0: (1, [256, 512]), 1: (1, [256, 640]), 2: (2, [256, 614]), 10: (2, [256, 627]), 11: (2, [256, 627])}
    assert sorted(map(tuple, negatives.mine(usable, F.col("vec_id") == 0).collect())) == mined(keep, lambda i: i == 0)
    assert negatives.mine(negatives.usable(df.limit(0), whole, F.col("label")), F.col("vec_id") == 0).count() == 0


def test_hard_negatives_query(spark):
    rows = {}
    for i, v, label in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        rows[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    got = QUERIES["op11_hard_negatives"][0](spark, SF).collect()
    assert sorted(map(tuple, got)) == mined(rows, lambda i: i % 100 == 0)


def sketched(text, words=5, k=128):
    own = [xxhash.xxh64_digest(w.encode(), 42)[::-1] for w in brute.BLANK_SPLIT.findall(text or "")]
    found = set()
    for i in range(max(1, len(own) - words + 1) if own else 0):
        h = 42
        for w in own[i : i + words]:
            h = xxhash.xxh64_intdigest(w, h)
        found.add(h >> 1)
    return sorted(found)[:k]


def alike(a, b, k=128):
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def test_sketches(spark, edges, edge_rows, no_documents):
    got = fingerprints.with_sketches(edges).select("doc_id", "text", "sketch").collect()
    assert sorted(map(tuple, got), key=sort_key) == sorted(((i, t, sketched(t)) for i, t, *_ in edge_rows), key=sort_key)
    assert fingerprints.with_sketches(no_documents).count() == 0
    pair = spark.createDataFrame([(sketched(a), sketched(b)) for _, a, *_ in edge_rows[:17] for _, b, *_ in edge_rows[:17]], "a array<long>, b array<long>")
    for r in pair.select("a", "b", fingerprints.resemblance(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == alike(r.a, r.b)


def test_sketches_estimate_and_merge(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30_000)]
    rows = []
    for i, share in enumerate((0.1, 0.5, 0.9)):
        n = int(rng.integers(4_000, 9_000))
        start = i * 9_000
        kept = int(n * share)
        rows.append((i, n, share, " ".join(words[start : start + n]), " ".join(words[start : start + kept])))
    df = spark.createDataFrame(rows, "i int, n int, share double, whole string, part string")
    a, b = fingerprints.sketch(F.col("whole"), k=1024), fingerprints.sketch(F.col("part"), k=1024)
    out = df.select("n", "share", a.alias("a"), b.alias("b")).select(
        "n", "share", fingerprints.resemblance(F.col("a"), F.col("b"), 1024).alias("j"),
        fingerprints.different_shingles(F.col("a"), 1024).alias("d"),
        fingerprints.containment(F.col("b"), F.col("a"), 1024).alias("inside"),
        fingerprints.merged(F.col("a"), F.col("b"), 1024).alias("m"), "a",
    )
    for r in out.collect():
        assert abs(r.j - r.share) < 0.06 and abs(r.d / r.n - 1) < 0.12 and r.inside > 0.85 and r.m == r.a


def test_group_sketches(spark, edges, edge_rows):
    got = {r.source: r.sketch for r in fingerprints.group_sketches(fingerprints.with_sketches(edges, k=16), ["source"], 16).collect()}
    want = collections.defaultdict(set)
    for _, text, _, source, _ in edge_rows:
        want[source].update(sketched(text, k=16))
    assert got == {s: sorted(h)[:16] for s, h in want.items()}


def test_following_rows(spark, edges, edge_rows, no_documents):
    for block in (256, 4):
        got = with_following(edges, "behind", block=block).collect()
        ids = [r[0] for r in edge_rows]
        assert sorted(((r.doc_id, r.text) for r in got), key=sort_key) == sorted(((i, t) for i, t, *_ in edge_rows), key=sort_key)
        # The texts behind are the texts again, and single ids have their neighbour's.
        assert collections.Counter(r.behind for r in got) == collections.Counter(r[1] for r in edge_rows)
        texts = dict((r[0], r[1]) for r in edge_rows)
        order = sorted({i for i in ids if i is not None}, reverse=True)
        for r in got:
            if r.doc_id is not None and ids.count(r.doc_id) == 1 and r.doc_id != order[-1]:
                after = order[order.index(r.doc_id) + 1]
                assert r.behind in {t for i, t, *_ in edge_rows if i == after}
        first = [r.behind for r in got if r.doc_id is None]
        assert texts[order[0]] in first
    assert with_following(no_documents, "behind").count() == 0
    one = with_following(edges.filter("doc_id = 9"), "behind").collect()
    assert len(one) == 1 and one[0].behind == one[0].text


def test_fingerprint_query(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    want = {}
    for k, (i, text) in enumerate(rows):
        behind = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + behind[:half]
        a, b, c = sketched(text), sketched(edited), sketched(behind)
        hexed = ["".join(f"{h:016x}" for h in x) for x in (a, b)]
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexed, alike(a, b), alike(a, c))
    got = QUERIES["op12_fingerprints"][0](spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
    plan = QUERIES["op12_fingerprints"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def importance_rows(rows, items, longest=1, least=20, percent=10, buckets=10_000):
    def features(text):
        words = brute.ALNUM.findall((text or "").translate(brute.LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    all_s = collections.Counter(b for _, t in rows for b in features(t)[1])
    all_t = collections.Counter(b for t in items for b in features(t)[1])
    s, t = sum(all_s.values()), sum(all_t.values())
    out = []
    for i, text in rows:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((all_t[b] + 1) * (s + buckets) / ((all_s[b] + 1) * (t + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([words, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    n = len(able) * percent // 100
    drawn = [(*r[1:], k + 1 if k < n else None) for k, r in enumerate(able)]
    return sorted(drawn + [(*r[1:], None) for r in out if r[0] < least], key=sort_key)


def test_importance(spark, edges, edge_rows, no_documents):
    rows = [(i, t) for i, t, *_ in edge_rows]
    items = [None, "", rows[8][1], rows[30][1], "x" * 450]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    for options in ({"percent": 60}, {"percent": 100, "block": 3, "longest": 2}, {"least": 0, "percent": 35, "block": 5, "buckets": 7}):
        got = importance.ranked(edges, target, **options).drop("text_hash").collect()
        plain = {k: v for k, v in options.items() if k != "block"}
        assert sorted(map(tuple, got), key=sort_key) == importance_rows(rows, items, **plain)
    drawn = importance.resampled(edges, target, percent=60)
    assert drawn.columns == edges.columns
    want = collections.Counter(r[0] for r in importance_rows(rows, items, percent=60) if r[4] is not None)
    assert collections.Counter(r.doc_id for r in drawn.collect()) == want
    assert importance.ranked(no_documents, target).count() == 0
    assert importance.ranked(edges, target.limit(0)).count() == len(rows)


def test_radix_ranks_of_wide_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(i), 0, int(f), 0, int(s)) for k, (i, f, s) in enumerate(zip(rng.integers(-(1 << 62), 1 << 62, 400), rng.integers(0, 9, 400), rng.integers(-90_000, 90_000, 400)))]
    rows += [(1000 + k, *r[1:]) for k, r in enumerate(rows[:200])]
    columns = "row long, doc_id long, text_hash long, n_features long, weight long, score long"
    df = spark.createDataFrame(rows, columns).repartition(4)
    got = importance.radix_ranked(df, importance._digits(df), block=64).orderBy("place").collect()
    assert [r.place for r in got] == list(range(600))
    assert [(r.score, r.doc_id, r.n_features) for r in got] == sorted(((r[5], r[1], r[3]) for r in rows), key=lambda x: (-x[0], x[1], x[2]))


def test_importance_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op13_importance"][0](spark, SF).collect()
    assert sorted(map(tuple, got), key=sort_key) == importance_rows(rows, items)
