"""Ordered regex taxonomies compiled to Column expressions.

A taxonomy is a plain dict (see ``fixed_values.TITLE_TAXONOMY``).  It is read once
on the driver; matching runs in the JVM inside the scan stage.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as sre
from re._parser import parse as sre_parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import _col

__all__ = ["java_pattern", "matches", "normalize_text", "required_literals", "taxonomy_counts", "taxonomy_match", "taxonomy_rule_ids"]

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_pattern(pattern: str) -> str:
    r"""Same meaning in Java regex: ASCII word boundary, no vertical tab in \s.

    Next to a literal word character one look-around decides a boundary; anywhere else both
    directions are tested.
    """
    opening = re.compile(r"\\b(?=[A-Za-z0-9_](?![?*{]))")
    closing = re.compile(r"(?<=[^\\][A-Za-z0-9_])\\b|(?<=[^\\][A-Za-z0-9_][A-Za-z0-9_]\?)\\b")
    out = closing.sub(lambda _: f"(?!{_WORD})", pattern)
    out = opening.sub(lambda _: f"(?<!{_WORD})", out)
    return out.replace(r"\b", _BOUNDARY).replace(r"\s", r"[\t\n\f\r ]")


def _holds_any(c, literals: frozenset[str]) -> Column:
    shortest = [x for x in sorted(literals) if not any(y != x and y in x for y in literals)]
    return reduce(lambda a, b: a | b, [F.contains(_col(c), F.lit(x)) for x in shortest])


def matches(c, pattern: str) -> Column:
    """Whether the pattern is found; a search for the literals that it must hold comes first and costs a small part of it."""
    literals, found = required_literals(pattern), _col(c).rlike(java_pattern(pattern))
    return _holds_any(c, literals) & found if literals else found


def normalize_text(c, taxonomy: dict) -> Column:
    base = F.lower(F.regexp_replace(F.trim(_col(c)), r"[\t\n\f\r ]+", " "))
    return reduce(lambda e, rule: F.regexp_replace(e, java_pattern(rule[0]), rule[1]),
                  taxonomy.get("replacements", []), base)


def _excluded(c, category: dict) -> Column:
    rules = [matches(c, p) for _, p in category.get("exclude") or []]
    return reduce(lambda a, b: a | b, rules, F.lit(False))


def _best(options: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of several conditions that all hold, the one whose shortest literal is longest."""
    known = [o for o in options if o]
    return max(known, key=lambda o: (min(map(len, o)), -len(o))) if known else None


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern: parsed together, their common first letters would be moved in front."""
    depth, bracket, start, out, at = 0, False, 0, [], 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 1
        elif bracket:
            bracket = ch != "]"
        elif ch == "[":
            bracket = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            out.append(pattern[start:at])
            start = at + 1
        at += 1
    out.append(pattern[start:])
    return out


def required_literals(pattern: str) -> frozenset[str] | None:
    """Strings of which every match of the pattern holds at least one; None when there is no such set."""
    def of(parts) -> frozenset[str] | None:
        options, run = [], ""
        for op, arg in [*parts, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if run:
                options.append(frozenset([run]))
                run = ""
            if op is sre.SUBPATTERN:
                options.append(of(arg[-1]))
            elif op is sre.BRANCH:
                each = [of(b) for b in arg[1]]
                options.append(frozenset().union(*each) if all(each) else None)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                options.append(of(arg[2]))
        return _best(options)
    each = [of(sre_parse(p)) for p in _alternatives(pattern)]
    return frozenset().union(*each) if all(each) else None


def _may_include(c, taxonomy: dict) -> Column:
    """Tells most texts apart: can any rule of any category match at all."""
    each = [required_literals(p) for n in taxonomy["order"] for _, p in taxonomy["categories"][n]["include"]]
    return _holds_any(c, frozenset().union(*each)) if all(each) else _col(c).isNotNull()


def taxonomy_match(c, taxonomy: dict) -> Column:
    """First category (in ``order``) with an include hit and no exclude hit; NULL text -> NULL."""
    def hit(name):
        category = taxonomy["categories"][name]
        included = reduce(lambda a, b: a | b, [matches(c, p) for _, p in category["include"]])
        return F.when(included & ~_excluded(c, category), F.lit(name))
    return F.when(_may_include(c, taxonomy), F.coalesce(*[hit(name) for name in taxonomy["order"]]))


def taxonomy_rule_ids(c, taxonomy: dict) -> Column:
    """All matching ``category/rule`` ids in declared order; [] when nothing matches."""
    entries = []
    for name in taxonomy["order"]:
        category = taxonomy["categories"][name]
        allowed = ~_excluded(c, category)
        entries += [F.when(matches(c, p) & allowed, F.lit(f"{name}/{rule}"))
                    for rule, p in category["include"]]
    return (F.when(_may_include(c, taxonomy), F.array_compact(F.array(*entries)))
             .otherwise(F.array().cast("array<string>")))


def taxonomy_counts(df, c, taxonomy: dict):
    """(category, texts, rules): texts of each category, NULL for none, and how many rules they hit.

    Equal texts are counted map-side first, so the patterns run once per distinct text, behind the exchange of that count
    and therefore in parallel at any layout of the files.
    """
    counted = df.select(_col(c).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    told = counted.select("_n", normalize_text("_t", taxonomy).alias("_t")).select(
        "_n", taxonomy_match("_t", taxonomy).alias("category"), F.size(taxonomy_rule_ids("_t", taxonomy)).alias("_r"))
    return told.groupBy("category").agg(F.sum("_n").alias("texts"), F.sum(F.col("_r") * F.col("_n")).alias("rules"))
