"""Sections of a document by its headers, and what they imply for findings that no sentence qualifies."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions.text import let_each, map_of

_ALIASES = dict(lexicon.pairs(lexicon.SECTION_ALIASES))
_NAMES = sorted(_ALIASES, key=len, reverse=True)
#: A header: a name and a colon at the start of the text or of a line.
HEADER = r"(?iu)(?:\A|(?<=\n))[ \t]*(" + "|".join(map(re.escape, _NAMES)) + r")[ \t]*:"
SECTIONS = "array<struct<section:string,start:int,end:int>>"
PREAMBLE = "preamble"


def section_spans(text: Column) -> Column:
    """array<struct<section, start, end>>: bodies from a header's end to the next header; a preamble before the first; all of the text is one without headers."""
    aliases = map_of(_ALIASES)

    def spans(parts: Column, heads: Column, names: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            start = state["pos"] + F.length(F.get(heads, i))
            end = start + F.length(F.get(parts, i + 1))
            span = F.struct(F.try_element_at(aliases, F.lower(F.get(names, i))).alias("section"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("pos"), F.array_append(state["out"], span).alias("out"))

        first = F.length(F.get(parts, F.lit(0)))
        preamble = F.array(F.struct(F.lit(PREAMBLE).alias("section"), F.lit(0).alias("start"), first.alias("end")))
        empty = F.array().cast(SECTIONS)
        begin = F.struct(first.alias("pos"), F.when((first > 0) | (F.size(heads) == 0), preamble).otherwise(empty).alias("out"))
        return F.when(F.size(heads) == 0, preamble).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(heads) - 1), begin, add)["out"])

    heads = F.regexp_extract_all(text, F.lit(HEADER), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(HEADER), F.lit(1))
    return let_each(F.split(text, HEADER, -1), lambda p: let_each(heads, lambda h: let_each(names, lambda n: spans(p, h, n))))


def section_at(spans: Column, offset: Column) -> Column:
    """The section that holds offset; the preamble if none does."""
    return F.coalesce(F.get(F.filter(spans, lambda x: (x["start"] <= offset) & (offset < x["end"])), F.lit(0))["section"], F.lit(PREAMBLE))


def section_default(section: Column, defaults: Mapping[str, str] = lexicon.SECTION_DEFAULT) -> Column:
    """The assertion that a section implies, null for none."""
    return F.try_element_at(map_of(defaults), section)


def section_authority(section: Column, authority: Mapping[str, int] = lexicon.SECTION_AUTHORITY) -> Column:
    return F.coalesce(F.try_element_at(map_of(authority), section), F.lit(lexicon.OTHER_AUTHORITY))
