"""Classification of documents and queries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t


def document_type(text: Column, types=rules.DOCUMENT_TYPES, default: str = "general") -> Column:
    """The first type with a key word in the text."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, needles in reversed(types):
        out = F.when(t.contains_any(low, needles), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def query_type(query: Column) -> Column:
    """question, comparison, summary or general, by words that occur anywhere in the query."""
    low = F.lower(query)
    return (
        F.when(t.contains_any(low, rules.QUESTION_WORDS), "question")
        .when(t.contains_any(low, rules.COMPARISON_WORDS), "comparison")
        .when(t.contains_any(low, rules.SUMMARY_WORDS), "summary")
        .otherwise("general")
    )


def key_terms(query: Column) -> Column:
    """Lower-case words over two characters that are no function words, in order."""
    return F.filter(
        t.words(F.lower(query)),
        lambda w: (F.length(w) > 2) & ~w.isin(rules.QUERY_STOP_WORDS),
    )


def analyze_query(query: Column, lemmas: Column | None = None) -> Column:
    """Keywords, type and the processed query.

    ``lemmas`` are the content-word lemmas of a language model, if one is at hand; the
    words of the query over two characters follow them.
    """
    own = F.filter(t.words(F.lower(query)), lambda w: F.length(w) > 2)
    keywords = F.array_distinct(own if lemmas is None else F.concat(lemmas, own))
    return F.struct(
        query.alias("original_query"),
        keywords.alias("keywords"),
        query_type(query).alias("query_type"),
        F.array_join(F.slice(keywords, 1, 10), " ").alias("processed_query"),
    )


def methods_mentioned(text: Column) -> Column:
    """Names called as ``name()``, lower case, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(t.java(rules.CALL_PATTERN)), F.lit(1))
    # Most texts hold no bracket at all and need no pattern scan.
    return F.when(text.contains("("), F.transform(found, F.lower)).otherwise(t.literals([]))


def concept_names() -> list[str]:
    names = {*rules.TECHNICAL_TERMS}
    for concept, related in rules.CONCEPTS.items():
        names |= {concept, *related}
    return sorted(names)


def technical_concepts(low: Column, names: list[str] | None = None) -> Column:
    """Concepts, related terms and technical terms in a lower-case query, sorted."""
    return F.filter(t.literals(names or concept_names()), lambda n: low.contains(F.lower(n)))


def programming_language(low: Column, languages=rules.LANGUAGE_WORDS) -> Column:
    """The first language with a word in a lower-case query."""
    out = F.lit(None).cast("string")
    for name, needles in reversed(languages):
        out = F.when(t.contains_any(low, needles), F.lit(name)).otherwise(out)
    return out


def _score(low: Column, patterns: list[str], keywords: list[str]) -> Column:
    hits = F.lit(0.0)
    for pattern in patterns:
        hit = low.rlike("(?i)" + t.java(pattern))
        if r"\(\)" in pattern:
            hit = low.contains("()") & hit
        hits = hits + F.when(hit, rules.PATTERN_WEIGHT).otherwise(0.0)
    found = F.size(F.filter(t.literals(keywords), lambda k: low.contains(k)))
    return hits + found / F.lit(len(keywords)) * rules.KEYWORD_WEIGHT


_RULE = "array<struct<name:string,precise:boolean,route:string>>"


def best_rule(low: Column, query_rules=rules.QUERY_RULES) -> Column:
    """The best scoring query type; a later type wins only with a higher score."""
    facts = t.table([{"name": n, "precise": p, "route": r} for n, _, _, p, r in query_rules], _RULE)
    scores = F.array(*[_score(low, patterns, keywords) for _, patterns, keywords, _, _ in query_rules])
    scored = F.zip_with(scores, facts, lambda s, f: F.struct(s.alias("score"), f.alias("rule")))
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(_RULE[6:-1]).alias("rule"))
    return F.aggregate(scored, nothing, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def classify_query(query: Column, query_rules=rules.QUERY_RULES) -> Column:
    """The nine-field classification of a query as one struct column."""

    def facts(low: Column) -> Column:
        methods = F.sort_array(F.array_distinct(methods_mentioned(query)))
        concepts = technical_concepts(low)
        return F.struct(
            low.alias("low"),
            methods.alias("methods"),
            concepts.alias("concepts"),
            t.contains_any(low, rules.PROGRAMMING_WORDS).alias("worded"),
            best_rule(t.strip(low), query_rules).alias("best"),
        )

    def build(s: Column) -> Column:
        methods, rule = s["methods"], s["best"]["rule"]
        return F.when(
            (F.size(methods) > 0) | (F.size(s["concepts"]) > 0) | s["worded"],
            F.struct(
                F.lit("technical").alias("type"),
                rule["name"].alias("subtype"),
                programming_language(s["low"]).alias("programming_language"),
                methods.alias("methods_mentioned"),
                s["concepts"].alias("technical_concepts"),
                F.coalesce(rule["precise"], F.lit(False)).alias("requires_precision"),
                s["best"]["score"].alias("confidence"),
                F.coalesce(rule["route"], F.lit("standard_retrieval")).alias("routing_strategy"),
                special_processing(rule["name"], methods).alias("specialized_processing"),
            ),
        ).otherwise(
            F.struct(
                F.lit("general").alias("type"),
                F.lit(None).cast("string").alias("subtype"),
                F.lit(None).cast("string").alias("programming_language"),
                t.literals([]).alias("methods_mentioned"),
                t.literals([]).alias("technical_concepts"),
                F.lit(False).alias("requires_precision"),
                F.lit(0.0).alias("confidence"),
                F.lit("standard").alias("routing_strategy"),
                t.literals([]).alias("specialized_processing"),
            )
        )

    return t.let(t.let(F.lower(query), facts), build)


def special_processing(kind: Column, methods: Column) -> Column:
    compare = (kind == "method_comparison") & (F.size(methods) >= 2)
    explain = kind == "method_explanation"
    return F.array_compact(
        F.array(
            F.when(compare, F.lit("comparative_analysis")),
            F.when(compare, F.lit("technical_validation")),
            F.when(explain, F.lit("method_signature_extraction")),
            F.when(explain, F.lit("behavior_analysis")),
            F.when(F.size(methods) > 0, F.lit("method_documentation_retrieval")),
            F.lit("technical_accuracy_check"),
        )
    )


def technical_variants(query: Column, classification: Column) -> Column:
    """Search variants of a technical query, the query itself first, at most four."""
    methods = classification["methods_mentioned"]
    facts = t.table(
        [{"m": n.removesuffix("()").lower(), "c": rules.CONCEPTS[n][:2]} for n in rules.THREADING_CONCEPTS],
        "array<struct<m:string,c:array<string>>>",
    )

    def for_method(m: Column) -> Column:
        known = F.flatten(F.transform(F.filter(facts, lambda f: f["m"] == m), lambda f: f["c"]))
        return F.transform(known, lambda c: F.concat_ws(" ", query, c))

    language = classification["programming_language"]
    comparing = (classification["subtype"] == "method_comparison") & (F.size(methods) >= 2)
    rest = F.array_compact(
        F.array(
            F.when(language.isNotNull(), F.concat(language, F.lit(" "), query)),
            F.when(
                comparing,
                F.concat(
                    F.lit("difference between "),
                    F.array_join(methods, " and "),
                    F.lit(" behavior synchronization blocking"),
                ),
            ),
        )
    )
    extra = F.concat(F.flatten(F.transform(methods, for_method)), rest)
    return F.when(
        classification["type"] == "technical", F.slice(F.concat(F.array(query), extra), 1, 4)
    ).otherwise(F.array(query))
