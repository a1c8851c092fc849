"""Places of a pattern in a text, with built-in functions only.

``\\G(.*?)(pattern)`` walks a text once: each find begins where the last one
ended, so the pieces between matches and the matches themselves give every
position by adding lengths (in code points).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters between words: ASCII other than letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: One place: start, end (exclusive), length of the value at its end.
PLACE = "struct<s:int,e:int,n:int>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def walk(text: Column, pattern: Column, group: int = 0) -> Column:
    """array<struct<p,m,v>>: text before each match, the match, and the value
    (the pattern's own capturing group number ``group``, 0: the whole match)."""
    full = F.concat(F.lit(r"\G(?s:(.*?))("), pattern, F.lit(")"))
    pick = lambda g: F.regexp_extract_all(text, full, F.lit(g))
    return F.arrays_zip(pick(1).alias("p"), pick(2).alias("m"), pick(2 + group).alias("v"))


def places(text: Column, pattern: Column, group: int = 0) -> Column:
    """All places of ``pattern``, leftmost and non-overlapping."""
    none = F.array().cast(f"array<{PLACE}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        here = F.struct(start.alias("s"), end.alias("e"), F.char_length(x["v"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(walk(text, pattern, group), F.struct(F.lit(0).alias("at"), none.alias("out")),
                       step, lambda acc: acc["out"])


def words(text: Column) -> Column:
    """All words in order, before lower-casing: the class holds both cases of
    A-Z.  (Splitting takes linear time; extracting all matches does not.)"""
    return F.array_remove(F.split(text, NOT_WORD + "+"), "")


def holds_any(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out
