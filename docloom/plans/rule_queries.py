"""Query classification, variants and answer checks over conversation turns.

The given tables hold invented words, so the turns are joined with technical phrases
chosen by conversation and turn: every rule is met, and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.functions.classify import classify_query, technical_variants
from docloom.functions.validate import claims, validate_answer
from docloom.plans import sql as q
from docloom.plans.registry import query

ASKED = [
    "yield() vs join() in java:",
    "Explain wait() and notifyAll()",
    "What is the purpose of sleep( ) method?",
    "how to implement a mutex lock, example of usage",
    "difference between join() and yield()",
    "why does the error say the thread is blocking",
    "memory usage and performance of HashMap in python",
    "race condition or deadlock in a critical section",
    "",
    "golang channel syntax for pandas",
]
ANSWERED = [
    "yield() blocks until completion, so it is a synchronization mechanism.",
    "The main thread will complete before the others with join(). Then join acts as a scheduling hint!",
    "wait() releases monitor lock and waits for notification. sleep() releases monitor locks.",
    "yield is blocking while join is cooperative scheduling. The thread method pauses; yield and join differ in blocking",
    "join() waits for target thread completion and yield() is a cooperative hint",
    "",
    "No idea.",
]
CONTEXTS = ["cooperative yielding is not a blocking call", "nothing of note"]

_ASKED_SQL = f"([{', '.join(q.quote(x) for x in ASKED)}])[((conv_id * 3 + turn) % {len(ASKED)} + 1)::INTEGER] || ' ' || text"
_ANSWERED_SQL = f"([{', '.join(q.quote(x) for x in ANSWERED)}])[((conv_id + turn) % {len(ANSWERED)} + 1)::INTEGER] || ' ' || text"
_CONTEXT_SQL = f"([{', '.join(q.quote(x) for x in CONTEXTS)}])[(conv_id % 2 + 1)::INTEGER]"
_TURNS = f"SELECT conv_id, turn, {_ASKED_SQL} AS question, {_ANSWERED_SQL} AS answer, {_CONTEXT_SQL} AS context FROM conversations"


def _pick(items, index):
    return F.get(t.literals(items), F.pmod(index, F.lit(len(items))).cast("int"))


def turns(db):
    text = F.col("text")
    return db.conversations.select(
        "conv_id",
        "turn",
        F.concat(_pick(ASKED, F.col("conv_id") * 3 + F.col("turn")), F.lit(" "), text).alias("question"),
        F.concat(_pick(ANSWERED, F.col("conv_id") + F.col("turn")), F.lit(" "), text).alias("answer"),
        _pick(CONTEXTS, F.col("conv_id")).alias("context"),
    )


def _score_sql(patterns, keywords) -> str:
    hits = "0::DOUBLE" + "".join(
        f" + CASE WHEN regexp_matches(low, '{q.re2(p)}', 'i') THEN 0.4::DOUBLE ELSE 0 END" for p in patterns
    )
    found = " + ".join(f"contains(low, {q.quote(k)})::INTEGER" for k in keywords)
    return f"({hits} + ({found})::DOUBLE / {len(keywords)} * 0.6::DOUBLE)"


def _calls(x: str) -> str:
    found = f"regexp_extract_all({x}, '([{q.WORD}]+)[{q.SPACE}]*\\([{q.SPACE}]*\\)', 1)"
    return f"list_transform({found}, lambda m: lower(m))"


_NAMES = sorted({*rules.CONCEPTS, *(x for v in rules.CONCEPTS.values() for x in v), *rules.TECHNICAL_TERMS})
_CONCEPTS = f"list_filter([{', '.join(q.quote(n) for n in _NAMES)}], lambda n: contains(lower(question), lower(n)))"
_LANGUAGE = "CASE " + " ".join(
    f"WHEN {q.has_any('lower(question)', words)} THEN {q.quote(name)}" for name, words in rules.LANGUAGE_WORDS
) + " END"
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(rules.QUERY_RULES))) + ")"
_KIND = "CASE WHEN best <= 0 THEN NULL " + " ".join(
    f"WHEN s{i} = best THEN '{r[0]}'" for i, r in enumerate(rules.QUERY_RULES)
) + " END"
_PRECISE = "coalesce(kind IN (" + ", ".join(f"'{r[0]}'" for r in rules.QUERY_RULES if r[3]) + "), false)"
_ROUTE = "CASE " + " ".join(f"WHEN kind = '{r[0]}' THEN '{r[4]}'" for r in rules.QUERY_RULES) + " ELSE 'standard_retrieval' END"
_CLASSIFIED = f"""
  SELECT conv_id, turn, question, answer, context,
         CASE WHEN tech THEN 'technical' ELSE 'general' END AS type,
         CASE WHEN tech THEN kind END AS subtype,
         CASE WHEN tech THEN {_LANGUAGE} END AS programming_language,
         CASE WHEN tech THEN methods ELSE [] END AS methods,
         CASE WHEN tech THEN concepts ELSE [] END AS concepts,
         tech AND {_PRECISE} AS requires_precision,
         CASE WHEN tech THEN round(best, 6) ELSE 0 END AS confidence,
         CASE WHEN tech THEN {_ROUTE} ELSE 'standard' END AS routing_strategy,
         CASE WHEN tech THEN array_to_string(list_filter([
            CASE WHEN kind = 'method_comparison' AND len(methods) >= 2 THEN 'comparative_analysis' END,
            CASE WHEN kind = 'method_comparison' AND len(methods) >= 2 THEN 'technical_validation' END,
            CASE WHEN kind = 'method_explanation' THEN 'method_signature_extraction' END,
            CASE WHEN kind = 'method_explanation' THEN 'behavior_analysis' END,
            CASE WHEN len(methods) > 0 THEN 'method_documentation_retrieval' END,
            'technical_accuracy_check'], lambda x: x IS NOT NULL), ',') ELSE '' END AS specialized_processing
  FROM (SELECT *, {_KIND} AS kind, (len(methods) > 0 OR len(concepts) > 0 OR {q.has_any('low', rules.PROGRAMMING_WORDS)}) AS tech
        FROM (SELECT *, {_BEST} AS best FROM (
          SELECT *, {', '.join(f'{_score_sql(r[1], r[2])} AS s{i}' for i, r in enumerate(rules.QUERY_RULES))},
                 list_sort(list_distinct({_calls('question')})) AS methods, {_CONCEPTS} AS concepts
          FROM (SELECT *, {q.strip('lower(question)')} AS low FROM ({_TURNS})))))"""


@query(
    f"""SELECT conv_id, turn, type, subtype, programming_language, array_to_string(methods, ',') AS methods,
    array_to_string(concepts, ',') AS concepts, requires_precision, confidence, routing_strategy, specialized_processing
    FROM ({_CLASSIFIED})"""
)
def query_router(db):
    c = turns(db).select("conv_id", "turn", classify_query(F.col("question")).alias("c"))
    return c.select(
        "conv_id",
        "turn",
        "c.type",
        "c.subtype",
        "c.programming_language",
        F.array_join("c.methods_mentioned", ",").alias("methods"),
        F.array_join("c.technical_concepts", ",").alias("concepts"),
        "c.requires_precision",
        F.round("c.confidence", 6).alias("confidence"),
        "c.routing_strategy",
        F.array_join("c.specialized_processing", ",").alias("specialized_processing"),
    )


_FACTS = "CASE m " + " ".join(
    f"WHEN {q.quote(n.removesuffix('()').lower())} THEN [{', '.join(q.quote(x) for x in rules.CONCEPTS[n][:2])}]"
    for n in rules.THREADING_CONCEPTS
) + " ELSE []::VARCHAR[] END"


@query(
    f"""
    SELECT conv_id, turn, (i - 1)::INTEGER AS variant, vs[i] AS text FROM (
      SELECT *, unnest(range(1, least(len(vs), 4) + 1)) AS i FROM (
        SELECT conv_id, turn, list_concat([question],
            CASE WHEN type = 'technical' THEN list_concat(
              flatten(list_transform(methods, lambda m: list_transform({_FACTS}, lambda f: question || ' ' || f))),
              CASE WHEN programming_language IS NOT NULL THEN [programming_language || ' ' || question] ELSE [] END,
              CASE WHEN subtype = 'method_comparison' AND len(methods) >= 2
                   THEN ['difference between ' || array_to_string(methods, ' and ') || ' behavior synchronization blocking'] ELSE [] END)
            ELSE [] END) AS vs FROM ({_CLASSIFIED})))
    """
)
def technical_query_variants(db):
    rows = turns(db).select("conv_id", "turn", "question", classify_query(F.col("question")).alias("c"))
    return rows.select(
        "conv_id", "turn", F.posexplode(technical_variants(F.col("question"), F.col("c"))).alias("variant", "text")
    )


def _issue_rows() -> str:
    parts = []
    for name, (right, wrong) in rules.METHOD_FACTS.items():
        named = f"list_contains(all_methods, '{name}')"
        fix = f"{name} behavior: {'; '.join(right[:2])}"
        for phrase in wrong:
            parts.append((f"{named} AND contains(lower(answer), {q.quote(phrase)})", f"Incorrect statement about {name}: contains '{phrase}'", fix, True))
        words = sorted({w for fact in right for w in fact.split()})
        parts.append((f"{named} AND NOT {q.has_any('lower(answer)', words)}", f"Missing accurate description of {name} behavior", f"{name} correct behavior: {right[0]}", True))
    for pattern, fix in rules.MISCONCEPTIONS:
        parts.append((f"regexp_matches(lower(answer), '{pattern}')", f"Common misconception detected: {pattern}", fix, False))
    both = "subtype = 'method_comparison' AND list_contains(methods, 'yield') AND list_contains(methods, 'join')"
    tests = [
        f"NOT {q.has_any('lower(answer)', rules.YIELD_TERMS)}",
        f"NOT {q.has_any('lower(answer)', rules.JOIN_TERMS)}",
        "contains(lower(answer), 'join') AND contains(lower(answer), 'main thread complete')",
    ]
    for test, (issue, fix) in zip(tests, rules.COMPARISON_FINDINGS):
        parts.append((f"{both} AND {test}", issue, fix, True))
    rows = [
        f"CASE WHEN type = 'technical' AND {cond} THEN {{'issue': {q.quote(i)}, 'fix': {q.quote(f if s else '')}}} END"
        for cond, i, f, s in parts
    ]
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


_CLAIMS = (
    f"list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: {q.strip('s')}), "
    f"lambda s: {q.has_any('lower(s)', rules.CLAIM_STEMS)} AND length(s) > 10)"
)


@query(
    f"""
    WITH c AS (SELECT *, list_concat(methods, {_calls('answer')}) AS all_methods FROM ({_CLASSIFIED})),
    checked AS (SELECT *, {_issue_rows()} AS issues,
       CASE WHEN type = 'technical' AND contains(context, 'cooperative') AND contains(context, 'blocking')
            THEN len(list_filter({_CLAIMS}, lambda s: contains(lower(s), 'yield') AND contains(lower(s), 'join')
                 AND (contains(lower(s), 'blocking') OR contains(lower(s), 'cooperative')))) ELSE 0 END AS crossed FROM c),
    scored AS (SELECT *, round(greatest(0, 1 - 0.2::DOUBLE * crossed), 6) AS tech FROM checked)
    SELECT conv_id, turn, len(issues) = 0 AS is_accurate,
           CASE WHEN len(issues) = 0 THEN least(1, tech) ELSE round(greatest(0, tech - 0.2::DOUBLE * len(issues)), 6) END AS confidence_score,
           tech AS technical_score, array_to_string(list_transform(issues, lambda x: x.issue), '|') AS issues,
           array_to_string(list_transform(list_filter(issues, lambda x: x.fix <> ''), lambda x: x.fix), '|') AS corrections
    FROM scored
    """
)
def answer_validation(db):
    rows = turns(db).select("conv_id", "turn", "answer", "context", classify_query(F.col("question")).alias("c"))
    checked = rows.select(
        "conv_id", "turn", validate_answer(F.col("answer"), F.col("c"), F.array("context")).alias("v")
    )
    return checked.select(
        "conv_id",
        "turn",
        "v.is_accurate",
        "v.confidence_score",
        "v.technical_score",
        F.array_join(F.transform("v.issues_found", lambda x: x["issue"]), "|").alias("issues"),
        F.array_join("v.corrections_suggested", "|").alias("corrections"),
    )


@query(
    f"""
    SELECT conv_id, turn, (i - 1)::INTEGER AS claim_index, cs[i] AS claim
    FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT conv_id, turn, {_CLAIMS} AS cs FROM ({_TURNS})))
    """
)
def answer_claims(db):
    return turns(db).select("conv_id", "turn", F.posexplode(claims(F.col("answer"))).alias("claim_index", "claim"))
