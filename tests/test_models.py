"""Models over columns: batches, retries, time limits, errors as rows; summaries in two passes."""

import time

from pyspark.sql import functions as F

from docloom.operators.abstractive import compress_with_model, leading_words, summarize_with_model, two_pass
from docloom.operators.models import answerer, model_column


def test_only_failing_rows_have_errors(spark):
    def load():
        calls = []

        def model(values):
            calls.append(len(values))
            if any(v % 17 == 0 for v in values):
                raise RuntimeError("no " + str([v for v in values if v % 17 == 0][0]))
            return [{"word": str(v), "head": len(calls) * 0 + v} if v % 5 else "other" for v in values]

        return model

    df = spark.range(0, 500, numPartitions=3).select(F.when(F.col("id") != 400, F.col("id")).alias("x"))
    made = model_column(load, "struct<word:string,head:int>", batch=20)
    rows = df.withColumn("r", made("x")).select("x", "r.*").collect()
    assert len(rows) == 500
    for r in rows:
        if r.x is None:
            assert r.result is None and r.error is None
        elif r.x % 17 == 0:
            assert r.result is None and r.error == f"RuntimeError: no {r.x}"
        elif r.x % 5 == 0:
            assert r.result is None and r.error.startswith("Arrow")
        else:
            assert r.result.word == str(r.x) and r.result.head == r.x and r.error is None


def test_loaded_once_retried_and_timed_out(spark):
    def load():
        seen, made = set(), time.time_ns()

        def model(values):
            if "slow" in values:
                time.sleep(3)
            if "short" in values:
                return []
            new = set(values) - seen
            seen.update(values)
            if new:
                raise OSError("first call fails")
            return [str(made)] * len(values)

        return model

    words = ["a", "b", "slow", "c", "short", "d"] * 3
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").coalesce(1)
    made = model_column(load, batch=2, timeout=0.5, retries=1)
    rows = df.withColumn("r", made("w")).select("w", "r.*").collect()
    assert len(rows) == len(words)
    assert {r.error.split(":")[0] for r in rows if r.error} == {"TimeoutError", "ValueError"}
    assert all((r.error is not None) == (r.w in ("slow", "short")) for r in rows)
    assert len({r.result for r in rows if r.result}) == 1  # one load


def counting(folder):
    def load():
        def model(rows):
            with open(f"{folder}/calls", "a") as f:
                f.writelines(f"{len(text.split())} {most} {least}\n" for text, most, least in rows)
            if any("broken" in text for text, *_ in rows):
                raise RuntimeError("broken text")
            return [" ".join(text.split()[:most]) for text, most, _ in rows]

        return model

    return load


def test_two_passes(spark, tmp_path):
    def sentences(n):
        return " ".join(f"word{i} and more words of ten in this sentence here." for i in range(n // 10))

    rows = [(0, sentences(400)), (1, sentences(2400)), (2, None), (3, ""), (4, sentences(2400)), (5, "broken " + sentences(1500)), (6, "a b")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r.id: r for r in two_pass(df, counting(tmp_path), retries=0, batch=1).collect()}
    assert len(out) == len(rows)
    calls = [tuple(map(int, x.split())) for x in (tmp_path / "calls").read_text().splitlines()]
    pieces = out[1].abstract_pieces
    assert pieces >= 3 and all(n <= 800 for n, most, _ in calls if most not in (300,))
    # Equal texts are summarized once: the pieces, then one call on their summaries.
    assert sum(most == 300 // pieces + 50 and least == 50 // pieces for _, most, least in calls) >= pieces
    assert sum(most == 300 and n == pieces * (300 // pieces + 50) for n, most, _ in calls) == 1
    assert out[1].abstract == out[4].abstract and len(out[1].abstract.split()) == 300
    assert out[0].abstract_pieces == 1 and out[0].abstract == " ".join(rows[0][1].split()[:300])
    assert out[2].abstract is None and out[3].abstract is None and out[2].abstract_error is None
    assert out[5].abstract is None and "broken text" in out[5].abstract_error
    assert out[6].abstract == "a b"
    made = {r.id: r for r in summarize_with_model(df, counting(tmp_path), method="abstractive", retries=0).collect()}
    assert made[1].summary_type == "abstractive" and made[1].summary == out[1].abstract
    assert made[5].summary_type == "extractive" and made[5].summary and "broken" in made[5].summary_error
    assert made[6].summary == "a b" and made[6].summary_type == "original"


def test_compression_and_answers(spark, tmp_path):
    rows = [(0, "w " * 101), (1, "w " * 1000), (2, "few words"), (3, None), (4, "broken " + "w " * 200)]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r.id: r for r in compress_with_model(df, counting(tmp_path)).collect()}
    assert len(out[0].text.split()) == 50 and len(out[1].text.split()) == 150
    assert [out[i].compressed for i in range(5)] == [True, True, False, False, False]
    assert out[4].text == rows[4][1] and "broken" in out[4].compression_error

    def load():
        def model(prompts):
            if "bad" in prompts:
                raise RuntimeError("no answer")
            return [p.upper() for p in prompts]

        return model

    asked = spark.createDataFrame([("good one",), ("bad",)], "prompt string")
    got = asked.select("prompt", answerer(load)(F.col("prompt"), F.lit(""), F.lit("")).alias("a")).select("prompt", "a.*").collect()
    by = {r.prompt: r for r in got}
    assert by["good one"].answer == "GOOD ONE" and by["good one"].success and by["good one"].tokens_used == 4
    assert not by["bad"].success and by["bad"].answer is None and "no answer" in by["bad"].error


def test_stand_in():
    assert leading_words()([("a b  c", 2, 1)]) == ["a b"]
