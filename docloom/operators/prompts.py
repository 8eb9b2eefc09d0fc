"""Prompt texts as column expressions; the wording is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = {
    "question": "Answer from the passages below and nothing else. Say so if they hold no answer.",
    "summary": "Sum up the passages below in few words; keep the main facts.",
    "comparison": "Compare what the question names, using the passages below.",
}


def context_block(position: Column, source: Column, page: Column, score: Column, text: Column) -> Column:
    return F.concat(
        F.lit("["), position.cast("string"), F.lit("] "), F.coalesce(source, F.lit("Unknown")),
        F.lit(", page "), F.coalesce(page.cast("string"), F.lit("Unknown")),
        F.lit(", score "), F.format_string("%.4f", score), F.lit("\n"), text, F.lit("\n"),
    )


def technical_block(position: Column, source: Column, content_type: Column, method: Column, text: Column) -> Column:
    head = F.when(
        content_type == "method_documentation",
        F.concat(F.lit("first choice: method "), F.coalesce(method, F.lit("unknown"))),
    ).otherwise(F.lit("background"))
    return F.concat(
        F.lit("["), position.cast("string"), F.lit("] "), F.coalesce(source, F.lit("Unknown")), F.lit(" ("), head,
        F.lit(")\n"), text, F.lit("\n"),
    )


def gather(blocks: DataFrame, block: Column, by: str = "query_id", order: str = "position") -> DataFrame:
    """The blocks of each query, in order, as one text; a query has few blocks."""
    rows = blocks.select(by, F.col(order).alias("o"), block.alias("b"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "\n")
    return rows.groupBy(by).agg(joined.alias("context_text"))


def _prompt(*parts: tuple[str, Column | None]) -> Column:
    lines = [F.concat(F.lit(head), body) if body is not None else F.lit(head) for head, body in parts]
    return F.concat_ws("\n\n", *lines)


def plain_prompt(query: Column, context: Column, query_type: Column | None = None) -> Column:
    return _prompt(
        ("", _system(query_type)),
        ("Passages:\n", context),
        ("Question: ", query),
        ("Name the passages you use.", None),
        ("Answer:", None),
    )


def _system(query_type: Column | None) -> Column:
    out = F.lit(SYSTEM["question"])
    if query_type is not None:
        for name in ("summary", "comparison"):
            out = F.when(query_type == name, F.lit(SYSTEM[name])).otherwise(out)
    return out


def enhanced_prompt(query: Column, context: Column, query_type: Column, conversation: Column) -> Column:
    history = F.when(
        F.coalesce(conversation, F.lit("")) != "", F.concat(F.lit("Earlier in this talk:\n"), conversation)
    )
    return F.concat_ws("\n\n", _system(query_type), history, plain_tail(query, context))


def plain_tail(query: Column, context: Column) -> Column:
    return _prompt(("Passages:\n", context), ("Question: ", query), ("Name the passages you use.", None), ("Answer:", None))


def verification_prompt(query: Column, answer: Column, context: Column) -> Column:
    return _prompt(
        ("Check the answer against the passages only. List what is wrong and rate it from 1 to 10.", None),
        ("Question: ", query),
        ("Answer: ", answer),
        ("Passages:\n", context),
        ("Verdict:", None),
    )


def technical_prompt(query: Column, context: Column, classification: Column, conversation: Column) -> Column:
    """The prompt for the kind of technical question at hand."""
    methods = F.array_join(classification["methods_mentioned"], ", ")
    subtype = classification["subtype"]
    language = F.coalesce(classification["programming_language"], F.lit("the language in question"))
    task = (
        F.when(
            subtype == "method_comparison",
            F.concat(
                F.lit("Compare "), F.when(methods != "", methods).otherwise("the methods"),
                F.lit(": purpose, blocking or not, typical use, category; end with the main differences."),
            ),
        )
        .when(
            subtype == "method_explanation",
            F.concat(
                F.lit("Explain "), F.coalesce(F.get(classification["methods_mentioned"], F.lit(0)), F.lit("the method")),
                F.lit(": signature, purpose, blocking or not, category, conditions, side effects."),
            ),
        )
        .when(
            subtype.isin("synchronization", "synchronization_concepts"),
            F.lit("Explain the synchronization concepts: core ideas, blocking behavior, patterns, related concepts."),
        )
        .when(
            classification["requires_precision"],
            F.concat(F.lit("Be exact and use correct terms for "), language, F.lit(".")),
        )
        .otherwise(F.lit("Answer with care for technical detail."))
    )
    return F.concat_ws(
        "\n\n", task, F.nullif(conversation, F.lit("")), F.concat(F.lit("Passages:\n"), context), F.concat(F.lit("Question: "), query), F.lit("Answer:")
    )


def correction_prompt(query: Column, answer: Column, issues: Column, corrections: Column) -> Column:
    def bullets(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")

    return _prompt(
        ("The answer below has technical faults. Write it again without them.", None),
        ("Question: ", query),
        ("Answer: ", answer),
        ("Faults:\n", bullets(F.transform(issues, lambda x: x["issue"]))),
        ("Facts to use:\n", bullets(corrections)),
        ("Corrected answer:", None),
    )
