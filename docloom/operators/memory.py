"""Conversation memory: the last turns of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators.topk import top_k


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows.

    The join is on (session, turn), so a session with a large share of all turns is
    spread over all tasks.
    """
    asked = turns.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("query")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["session_id", "turn"])


def last_turns(pairs: DataFrame, n: int = Settings.max_history, order: str = "turn") -> DataFrame:
    """At most ``n`` newest entries per session; ``age`` is 1 for the newest."""
    return top_k(pairs, ["session_id"], [F.col(order).desc()], n, "age")


def session_context(pairs: DataFrame, n: int = Settings.history_in_prompt, order: str = "turn") -> DataFrame:
    """The last ``n`` entries of each session as prompt text, oldest first."""
    lines = F.concat(
        F.lit("Previous Q: "), F.col("query"), F.lit("\nPrevious A: "), F.col("response"), F.lit("\n\n")
    )
    recent = last_turns(pairs, n, order).select("session_id", F.col("age"), lines.alias("lines"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("o"), "lines")))
    return recent.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["lines"]), "").alias("context")
    )


def without_session(pairs: DataFrame, session_id) -> DataFrame:
    return pairs.where(F.col("session_id") != session_id)
