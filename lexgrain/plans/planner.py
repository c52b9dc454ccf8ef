"""From a pattern to what the index must hold: pure Python on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.dialect import literal_to_java, parse, required_literals, to_java
from ..functions.trigrams import case_groups, trigram_set


@dataclass(frozen=True)
class QueryPlan:
    """java: the pattern that verifies; contains: strings that a matching line holds."""

    java: str
    contains: tuple[str, ...] = ()


@dataclass(frozen=True)
class FullScan(QueryPlan):
    """No trigram is required."""


@dataclass(frozen=True)
class Literal(QueryPlan):
    """All trigrams of one string."""

    text: str = ""
    trigrams: tuple[int, ...] = ()


@dataclass(frozen=True)
class RegexWithLiterals(QueryPlan):
    """All trigrams of each required fragment."""

    trigram_sets: tuple[tuple[int, ...], ...] = ()


@dataclass(frozen=True)
class CaseInsensitive(QueryPlan):
    """One variant at least of each group."""

    groups: tuple[tuple[int, ...], ...] = ()


def plan(pattern: str, regex: bool = False, ignore_case: bool = False, dot_all: bool = False, strict: bool = True) -> QueryPlan:
    """strict: capture groups give no fragments; otherwise they do, which prunes more."""
    if not regex:
        java, data = literal_to_java(pattern, ignore_case), pattern.encode()
        if ignore_case:
            groups = case_groups(data)
            return CaseInsensitive(java, groups=tuple(map(tuple, groups))) if groups else FullScan(java)
        grams = trigram_set(data)
        return Literal(java, (pattern,), pattern, tuple(grams)) if grams else FullScan(java, (pattern,) if pattern else ())
    java = to_java(pattern, ignore_case, dot_all)
    if ignore_case:
        return FullScan(java)
    fragments = required_literals(parse(("(?s)" if dot_all else "") + pattern), into_captures=not strict)
    sets = [tuple(s) for f in fragments if (s := trigram_set(f.encode()))]
    return RegexWithLiterals(java, tuple(fragments), tuple(sets)) if sets else FullScan(java, tuple(fragments))
