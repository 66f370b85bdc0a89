"""The rule registry and its positional scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import checks
from spanveil.functions.text import MATCH, matches, normal_context
from spanveil.schemas import SPANS


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    score: float
    window: tuple[int, int]
    sources: tuple[str, ...]
    validator: Callable[[Column], Column] | None = None
    scan: bool = True
    keep_label: bool = False
    context: tuple[str, ...] = ()
    context_required: bool = False
    #: A pattern that each match contains and that is found fast: texts without it are not scanned.
    guard: str = ""


DOCUMENTS = ("BR_DOC", "BR_CPF", "CPF", "BR_CNPJ", "CNPJ", "BR_RG", "RG", "ID", "NUM_CANDIDATE")

# Grammars, scores, windows and sources of the rules, in the order in which their spans come.
RULES = (
    Rule("BR_CNPJ", r"(?U)(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)", 100, 0.99, (6, 18), DOCUMENTS, checks.cnpj_valid, guard=r"(?U)\d{3}"),
    Rule("BR_CPF", r"(?U)(?<!\d)\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?!\d)", 95, 0.99, (6, 16), DOCUMENTS, checks.cpf_valid, guard=r"(?U)\d{3}"),
    Rule("EMAIL", r"(?U)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 80, 0.95, (10, 60), ("EMAIL",), guard=r"@"),
    Rule("PHONE", r"(?U)(?:\(\d{2}\)\s*\d{4,5}-?\d{4}|(?<!\d)\d{2}\s?\d{4,5}-\d{4}(?!\d))", 78, 0.90, (6, 18), ("PHONE", "PHONE_NUMBER", "NUM_CANDIDATE"), guard=r"(?U)\d{4}"),
    Rule("CRM", r"(?iuU)CRM[\s/.-]*[A-Z]{2}\s*\d{4,7}", 75, 0.93, (6, 22), ("CRM", "ID", "NUM_CANDIDATE"), guard=r"(?iu)crm"),
    Rule("ZIPCODE", r"(?U)(?<!\d)\d{5}-\d{3}(?!\d)", 50, 0.90, (4, 10), ("ZIPCODE", "ZIP", "POSTAL_CODE", "NUM_CANDIDATE"), guard=r"(?U)\d-\d"),
    Rule("DATE", r"(?U)(?<!\d)\d{1,2}/\d{1,2}/\d{2,4}(?!\d)", 48, 0.88, (4, 12), ("DATE", "DATE_OF_BIRTH", "DOB", "NUM_CANDIDATE"), guard=r"(?U)\d/\d"),
    Rule("AGE", r"(?iuU)(?<!\d)\d{1,3}\s?anos?\b", 40, 0.85, (4, 10), ("AGE", "NUM_CANDIDATE"), guard=r"(?iu)ano"),
    Rule("BR_RG", r"(?U)(?<!\d)\d{1,2}\.\d{3}\.\d{3}-?[\dXx](?![\dXx])", 45, 0.88, (6, 16), DOCUMENTS, guard=r"(?U)\d\.\d"),
    Rule("DIGIT_RUN", r"(?U)(?<![\d])\d(?:[ .\-/]?\d)*(?![\d])", 10, 0.5, (8, 24), (*DOCUMENTS, "MEDICAL_RECORD", "MRN", "ZIP", "ZIPCODE", "POSTAL_CODE"), None, False, True),
)
BY_LABEL = {r.label: r for r in RULES}


def has_context(text: Column, start: Column, end: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a keyword stands within 40 characters before or 10 after."""
    low = F.greatest(F.lit(0), start - 40)
    near = normal_context(F.substring(text, low + 1, end + 10 - low))
    return F.greatest(*[F.contains(near, F.lit(k)) for k in keywords], F.lit(False))


def may_match(text: Column, rule: Rule) -> Column:
    """Whether the text holds what every match of the rule contains."""
    return F.contains(text, F.lit(rule.guard)) if rule.guard == re.escape(rule.guard) else F.regexp_like(text, F.lit(rule.guard))


def guarded(text: Column, rule: Rule) -> Column:
    """Matches of the rule; texts that cannot have one are not scanned."""
    return F.when(may_match(text, rule), matches(text, rule.pattern)).otherwise(F.array().cast(MATCH)) if rule.guard else matches(text, rule.pattern)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule; one with a validator gives only values whose check digits hold."""
    found = guarded(text, rule)
    if rule.validator is not None:
        found = F.filter(found, lambda m: rule.validator(m["txt"]))
    score = lambda m: F.lit(rule.score)
    if rule.context:
        if rule.context_required:
            found = F.filter(found, lambda m: has_context(text, m["start"], m["end"], rule.context))
        if rule.validator is None:
            score = lambda m: F.when(has_context(text, m["start"], m["end"], rule.context), min(0.99, rule.score + 0.05)).otherwise(rule.score)
    span = lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(rule.label).alias("label"), m["txt"].alias("txt"), score(m).cast("double").alias("score"),
        F.lit("regex").alias("origin"), F.lit(rule.validator is not None).alias("validated"), F.lit(False).alias("strong"),
    )
    return F.transform(found, span).cast(SPANS)


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of the scanning rules, in registry order."""
    return F.concat(*[rule_spans(text, r) for r in rules if r.scan])
