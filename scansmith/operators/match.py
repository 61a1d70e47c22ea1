"""The match kernel: all matches of a regular expression in a text, with the line of each, by expressions alone.

For an expression, `regexp_extract_all` gives what lies between its matches, and the matches; adding up line feeds along both
gives each match's line, in blocks, so that time is linear in the matches; a text without a match is searched once. Which
patterns run on a text is decided by their literal needles: one pass over the lower-cased text finds marks of them, behind which
needles are sought, so a text meets the few searches and expressions that it may match, not the whole catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scansmith.catalog import Pattern
from scansmith.functions.text import let, newlines


def present(low: Column, p: Pattern) -> Column:
    """Whether a lower-cased text may match."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(n)) for n in p.needles)) if p.needles else F.lit(True)


#: Characters from frequent to rare in scripts; what is not among them counts as rarer. It tells how fast gates are, not what they let pass.
_FREQUENT = "etaoinsrlhdcumpfg/.wyb\"' vk-:=xjqz0123456789_@"


def mark(needle: str) -> str:
    """Two characters that a needle holds, from its rarest one on; none of a needle that is shorter."""
    at = max(range(max(0, len(needle) - 1)), key=lambda i: (_FREQUENT.find(needle[i]) % 99, -i), default=0)
    return needle[at : at + 2] if len(needle) > 1 else ""


def gates(patterns: Sequence[Pattern]) -> dict[tuple[str, ...], list[int]]:
    """The places of patterns by the marks of their needles: a text without any of the marks holds none of the needles. Those under no mark are always let pass."""
    out: dict[tuple[str, ...], list[int]] = {}
    for place, p in enumerate(patterns):
        own = sorted({mark(n) for n in p.needles})
        out.setdefault(tuple(own) if all(own) else (), []).append(place)
    return out


def marked(low: Column, patterns: Sequence[Pattern]) -> Column:
    """The marks that a lower-cased text holds, found in one pass; as all are two characters long, no two begin at one place."""
    plain = lambda c: c if c.isalnum() else f"\\{c}"
    follow: dict[str, set[str]] = {}
    for m in {m for marks in gates(patterns) for m in marks}:
        follow.setdefault(m[0], set()).add(m[1])
    if not follow:
        return F.array().cast("array<string>")
    firsts = "".join(map(plain, sorted(follow)))
    both = "|".join(f"{plain(a)}[{''.join(map(plain, sorted(b)))}]" for a, b in sorted(follow.items()))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=[{firsts}])(?=({both}))"), F.lit(1)))


def candidates(low: Column, patterns: Sequence[Pattern], conditions: Sequence[Column], marks: Column | None = None) -> Column:
    """The places of the conditions that hold of a lower-cased text, each of which says that its pattern is present; most are passed over by a gate.

    marks are those of the text (`marked`), if they are at hand. No lambda is used: its whole operand would be interpreted.
    """
    marks, parts = marked(low, patterns) if marks is None else marks, []
    for any_of, places in gates(patterns).items():
        some = F.array(*(F.when(conditions[k], F.lit(k)).otherwise(F.lit(-1)) for k in places))
        parts.append(F.when(reduce(lambda a, b: a | b, (F.array_contains(marks, m) for m in any_of)), some).otherwise(F.array(F.lit(-1))) if any_of else some)
    return F.array_remove(F.flatten(F.array(*parts)), -1)


def clipped(text: Column, closing: Column) -> Column:
    """text up to the last place where a match can end, if its expression says so (closing), else all of it.

    An expression with an open run tries every beginning up to the end of the text; behind the last possible end, that is
    time without a match.
    """
    return F.when(closing.isNull(), text).otherwise(F.call_function("regexp_extract", text, closing, F.lit(0)))


def matches(text: Column, regex: Column, group: Column) -> Column:
    """Array of (match_ord, value, line, after): each match's group, its line, and what follows it up to the next one; null for no match."""
    some = lambda whole: F.when(F.size(whole) == 1, _single(text, regex, group, whole)).when(F.size(whole) > 1, _placed(text, regex, group, whole))
    return let(F.regexp_extract_all(text, regex, F.lit(0)), some)


def _running(counts: Column) -> Column:
    """The sums before each number of an array, in time linear in its length up to a small root: within blocks of about the
    root of its length, and over blocks. A fold that appends copies its array each time, so none is longer than that."""

    def sums(numbers: Column, start: Column) -> Column:
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, state, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(counts))).cast("int"))
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(counts) / n).cast("int") - 1)), lambda k: F.slice(counts, k * n + 1, n))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
    whole = lambda parts: F.flatten(F.zip_with(parts, sums(F.transform(parts, total), F.lit(0)), sums))
    return let(let(size, blocks), whole)


def _value(whole: Column, regex: Column, group: Column) -> Column:
    # a match holds its group, so that the expression need not search the text again
    return F.when(group == 0, whole).otherwise(F.call_function("regexp_extract", whole, regex, group))


def _between(text: Column, regex: Column) -> Column:
    """What lies before, between and behind the matches, which split would tell too, but compiles its expression for every text. An empty string may follow."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s:(.*?))(?:"), regex, F.lit("|\\z)")), F.lit(1))


def _single(text: Column, regex: Column, group: Column, whole: Column) -> Column:
    """The only match of a text, for which nothing is added up."""
    row = lambda parts: F.struct(F.lit(0).alias("match_ord"), _value(F.get(whole, F.lit(0)), regex, group).alias("value"), (newlines(F.get(parts, F.lit(0))) + 1).alias("line"), F.get(parts, F.lit(1)).alias("after"))
    return F.transform(F.array(_between(text, regex)), row)


def _placed(text: Column, regex: Column, group: Column, whole: Column) -> Column:

    def rows(parts: Column) -> Column:
        inside = F.transform(whole, lambda w: newlines(w))
        gaps = F.zip_with(F.slice(parts, F.lit(1), F.size(whole)), F.concat(F.array(F.lit(0)), F.slice(inside, F.lit(1), F.size(whole) - 1)), lambda b, n: newlines(b) + n)
        found = F.arrays_zip(whole.alias("w"), F.slice(parts, F.lit(2), F.size(whole)).alias("after"), gaps.alias("gap"))
        # line feeds up to a match: those before each earlier gap's end, and those of its own gap
        return F.zip_with(found, let(gaps, _running), lambda x, n: F.struct(_value(x["w"], regex, group).alias("value"), (n + x["gap"] + 1).cast("int").alias("line"), x["after"].alias("after")))

    return F.transform(let(_between(text, regex), rows), lambda x, i: F.struct(i.cast("int").alias("match_ord"), x["value"].alias("value"), x["line"].alias("line"), x["after"].alias("after")))
