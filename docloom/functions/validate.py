"""Rule checks of technical answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.functions.classify import methods_mentioned

_ISSUES = "array<struct<issue:string,correction:string,severity:string>>"


_RULES = "array<struct<method:string,words:array<string>,wanted:boolean,issue:string,correction:string,severity:string>>"


def _broken(rows: list[dict], low: Column, applies) -> Column:
    """Issues of the rules that apply and whose words are there (or, if wanted, are not)."""

    def is_broken(r: Column) -> Column:
        there = F.exists(r["words"], lambda w: low.contains(w))
        return applies(r) & (there != r["wanted"])

    return F.transform(
        F.filter(t.table(rows, _RULES), is_broken),
        lambda r: F.struct(r["issue"].alias("issue"), r["correction"].alias("correction"), r["severity"].alias("severity")),
    )


def _rule(method: str, words: list[str], wanted: bool, issue: str, correction: str) -> dict:
    return {
        "method": method, "words": words, "wanted": wanted, "issue": issue, "correction": correction,
        "severity": "medium",
    }


def method_rules(facts=rules.METHOD_FACTS) -> list[dict]:
    out = []
    for name, (right, wrong) in facts.items():
        fix = rules.METHOD_BEHAVIOR.format(name, "; ".join(right[:2]))
        for phrase in wrong:
            out.append(_rule(name, [phrase.lower()], False, rules.INCORRECT_STATEMENT.format(name, phrase), fix))
        words = sorted({w for fact in right for w in fact.lower().split()})
        out.append(
            _rule(name, words, True, rules.MISSING_DESCRIPTION.format(name), rules.METHOD_CORRECT_BEHAVIOR.format(name, right[0]))
        )
    return out


def method_issues(methods: Column, low: Column, facts=rules.METHOD_FACTS) -> Column:
    """Wrong statements about the named methods, and methods with no right statement."""
    return _broken(method_rules(facts), low, lambda r: F.array_contains(methods, r["method"]))


def comparison_issues(methods: Column, low: Column) -> Column:
    """Checks of a yield/join comparison."""
    no_yield, no_join, wrong = rules.COMPARISON_FINDINGS
    both = F.array_contains(methods, "yield") & F.array_contains(methods, "join")
    rows = [
        _rule("", rules.YIELD_TERMS, True, *no_yield),
        _rule("", rules.JOIN_TERMS, True, *no_join),
        _rule("join", ["main thread complete"], False, *wrong),
    ]
    return _broken(rows, low, lambda r: both & low.contains(r["method"]))


def misconception_issues(low: Column, patterns=rules.MISCONCEPTIONS) -> Column:
    found = [
        F.when(
            low.rlike("(?d)" + p),
            F.struct(
                F.lit(rules.MISCONCEPTION.format(p)).alias("issue"),
                F.lit(fix).alias("correction"),
                F.lit("high").alias("severity"),
            ),
        )
        for p, fix in patterns
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def claims(response: Column, stems=rules.CLAIM_STEMS, min_chars: int = 10) -> Column:
    """Sentences with a claim stem, trimmed, longer than ``min_chars``."""
    parts = F.transform(F.split(response, "[.!?]+"), t.strip)
    return F.filter(parts, lambda s: t.contains_any(F.lower(s), stems) & (F.length(s) > min_chars))


def contradictions(response: Column, context: Column) -> Column:
    """Number of yield/join claims that mix up what the context keeps apart."""
    mixed = F.exists(
        context, lambda c: F.lower(c).contains("cooperative") & F.lower(c).contains("blocking")
    )

    def crossed(claim: Column) -> Column:
        low = F.lower(claim)
        return (
            low.contains("yield") & low.contains("join")
            & (low.contains("blocking") | low.contains("cooperative"))
        )

    return F.when(mixed, F.size(F.filter(claims(response), crossed))).otherwise(0)


def validate_answer(response: Column, classification: Column, context: Column) -> Column:
    """Verdict on a technical answer as one struct; other answers pass unchecked."""
    asked = classification["methods_mentioned"]
    comparing = (classification["subtype"] == "method_comparison") & (F.size(asked) >= 2)
    none = F.array().cast(_ISSUES)

    def verdict(s: Column) -> Column:
        fixes = F.transform(F.concat(s["methods"], s["comparison"]), lambda x: x["correction"])
        issues = F.concat(s["methods"], s["misconceptions"], s["comparison"])
        n = F.size(issues)
        score = F.round(F.greatest(F.lit(0.0), 1.0 - 0.2 * s["crossed"]), 6)
        trusted = F.when(n == 0, F.least(F.lit(1.0), score)).otherwise(
            F.round(F.greatest(F.lit(0.0), score - 0.2 * n), 6)
        )
        return F.struct(
            (n == 0).alias("is_accurate"),
            trusted.alias("confidence_score"),
            issues.alias("issues_found"),
            fixes.alias("corrections_suggested"),
            score.alias("technical_score"),
        )

    technical = classification["type"] == "technical"
    methods = F.array_union(asked, methods_mentioned(response))

    def state(low: Column) -> Column:
        return F.struct(
            F.when(technical, method_issues(methods, low)).otherwise(none).alias("methods"),
            F.when(technical, misconception_issues(low)).otherwise(none).alias("misconceptions"),
            F.when(technical & comparing, comparison_issues(asked, low)).otherwise(none).alias("comparison"),
            F.when(technical, contradictions(response, context)).otherwise(0).alias("crossed"),
        )

    return t.let(t.let(F.lower(response), state), verdict)
