"""Session ring and expiring answers over several micro-batches and a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators.memory import last_turns, question_answer_pairs
from docloom.streaming.state import fresh_answers, session_ring, with_state_store
from tests.conftest import SF

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def run(stream, make, got, checkpoint, mode):
    def keep(batch, number):
        got.append([tuple(r) for r in batch.collect()])

    query = make(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()


def test_session_ring(stateful, tmp_path):
    pairs = question_answer_pairs(stateful.read.parquet(f"{SF}/conversations.parquet")).select("session_id", "turn", "query", "response")
    long = stateful.createDataFrame([(-1, t, f"q{t}", f"a{t}") for t in range(25)], "session_id long, turn long, query string, response string")
    pairs = pairs.unionByName(long).cache()
    source, got = str(tmp_path / "in"), []
    pairs.limit(0).write.mode("append").parquet(source)
    latest = {}
    for turn in range(3):  # every run is a restart from the checkpoint
        pairs.where(F.pmod(F.col("turn"), F.lit(3)) == turn).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.readStream.schema(pairs.schema).parquet(source)
        run(stream, lambda s: session_ring(s, 10), got, str(tmp_path / "state"), "update")
    for batch in got:
        by_session = {}
        for row in batch:
            by_session.setdefault(row[0], []).append(row)
        latest |= by_session
    want = {}
    for r in last_turns(pairs, 10).select("session_id", "turn", "query", "response", "age").collect():
        want.setdefault(r.session_id, []).append(tuple(r))
    assert {s: sorted(v) for s, v in latest.items()} == {s: sorted(v) for s, v in want.items()}
    assert len(latest[-1]) == 10


@pytest.mark.parametrize("ttl", [300, 24 * 3600])
def test_answers_expire(stateful, tmp_path, ttl):
    source, got = str(tmp_path / "in"), []
    batches = [[("a", "one", 0), ("b", "x", 10)], [("a", "two", ttl - 1), ("c", "y", ttl - 1)], [("a", "three", ttl), ("b", "z", ttl + 9)], [("b", "w", ttl + 10), ("a", "four", 2 * ttl - 1)], [("a", "five", 2 * ttl)]]
    schema = "key string, value string, created_at timestamp"
    stateful.createDataFrame([], schema).write.parquet(source)
    for rows in batches:
        made = [(k, v, START + datetime.timedelta(seconds=s)) for k, v, s in rows]
        stateful.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.readStream.schema(schema).parquet(source)
        run(stream, lambda s: fresh_answers(s, ttl, "1 hour"), got, str(tmp_path / "state"), "append")
    seen = sorted((r[0], r[1], (r[3] - r[2]).total_seconds()) for batch in got for r in batch)
    assert [x[:2] for x in seen] == [("a", "five"), ("a", "one"), ("a", "three"), ("b", "w"), ("b", "x"), ("c", "y")]
    assert {x[2] for x in seen} == {ttl}
