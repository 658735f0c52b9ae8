"""Label matchers and the predicates they compile to.

Matchers are ANDed. A matcher never matches a series without its label, whatever its value or pattern.
Range queries first drop matchers without name or value and all but the first of a name; series queries
take them as they are, so two of a name both must hold, one with an empty value matches nothing, and no
matchers match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.labels import METRIC
from .regex import Refused, translate


@dataclass(frozen=True)
class Matcher:
    name: str
    value: str
    is_regex: bool = False


def effective(matchers: Sequence[Matcher]) -> list[Matcher]:
    """Matchers with name and value, of each name the first; an empty one still counts as first."""
    seen: set[str] = set()
    out = []
    for m in matchers:
        if m.name and m.value and m.name not in seen:
            out.append(m)
        seen.add(m.name)
    return out


def value_predicate(value: Column, matcher: Matcher) -> Column:
    """Whether a label's value matches; null for a label that isn't there.

    Patterns of plain alternatives become equality or IN, and what a pattern's matches start with, end
    with or contain is tested first: these reach the Parquet reader, a pattern doesn't.
    """
    if not matcher.is_regex:
        return (value == matcher.value) & (value != "")
    try:
        t = translate(matcher.value)
    except Refused:
        return (value == matcher.value) & (value != "")
    if t.literals is not None:
        return value.isin(*(x for x in t.literals if x)) if any(t.literals) else F.lit(False)
    out = value.rlike(t.java) & (value != "")
    for test, text in ((F.startswith, t.prefix), (F.endswith, t.suffix), (F.contains, t.inner)):
        if text:
            out = test(value, F.lit(text)) & out
    return out


def predicate(matchers: Sequence[Matcher], labels: Column, metric: Column | None = None) -> Column:
    """All of the matchers over a label map. metric: a column that holds the map's METRIC entry, by
    which row groups are pruned."""
    if not matchers:
        return F.lit(False)
    out = None
    for m in matchers:
        value = metric if m.name == METRIC and metric is not None else F.element_at(labels, m.name)
        one = F.coalesce(value_predicate(value, m), F.lit(False)) if m.name != METRIC or metric is None else value_predicate(value, m)
        out = one if out is None else out & one
    return out


def range_matchers(metric: str, matchers: Sequence[Matcher]) -> list[Matcher]:
    """What a range query matches by: the effective matchers and the metric's name beside any matcher
    that the caller gave for it."""
    return [*effective(matchers), Matcher(METRIC, metric)]
