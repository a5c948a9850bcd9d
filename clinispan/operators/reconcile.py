"""One decision per finding and document, or an open conflict: never a guess between present and absent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions.sections import section_authority
from clinispan.functions.text import let

# How a decision was reached.
BASIS_SINGLE = "only one mention"
BASIS_AGREED = "the highest-authority mentions agree"
BASIS_TIED = "mentions disagree about whether the finding is present and no section authority separates them"
BASIS_OPEN = "mentions disagree about PRESENCE. Resolving automatically would either assert a finding a clinician denied, or drop one they asserted; both are decisions for a human"
POLICY = "A document that contradicts itself keeps every mention; an unresolved finding is reported, and left out of the rows unless asked for."

_MENTION = ("presence", "temporality", "assertion", "start", "end", "text", "section")


def _mention(e: Column, authority: Mapping[str, int]) -> Column:
    return F.struct(*(e[n].alias(n) for n in ("concept", "experiencer", *_MENTION)), section_authority(e["section"], authority).alias("authority"))


def _decision(mentions: Column) -> Column:
    """The decision for the mentions of one concept and experiencer, in the order of the text."""
    presences = F.array_distinct(F.transform(mentions, lambda m: m["presence"]))
    top = F.array_max(F.transform(mentions, lambda m: m["authority"]))
    first = F.get(mentions, F.lit(0))

    def decide(p: Column) -> Column:
        one, n_winners = F.size(mentions) == 1, F.size(p["winners"])
        conflict = F.size(p["presences"]) > 1
        denied = conflict & F.array_contains(p["presences"], "absent")
        agreed = F.size(F.array_distinct(F.transform(p["winners"], lambda m: m["presence"]))) == 1
        confidence = F.when(one, "single").when((n_winners == 1) & ~denied, "authoritative").when(agreed & ~denied, "agreed").otherwise("unresolved")
        winner = F.get(p["winners"], F.lit(0))

        def result(how: Column) -> Column:
            open_ = how == "unresolved"
            outranks = F.format_string("the %s mention outranks the others (authority %d)", winner["section"], winner["authority"])
            basis = F.when(one, BASIS_SINGLE).when(how == "authoritative", outranks).when(how == "agreed", BASIS_AGREED).when(denied & (n_winners > 1), BASIS_TIED).otherwise(BASIS_OPEN)
            sides = F.array_sort(F.array_distinct(F.transform(mentions, lambda m: F.struct(m["section"].alias("section"), m["presence"].alias("presence")))))
            return F.struct(
                first["concept"].alias("concept"),
                first["experiencer"].alias("experiencer"),
                F.when(~open_, winner["presence"]).alias("presence"),
                F.when(~open_, winner["temporality"]).alias("temporality"),
                F.size(mentions).alias("n_mentions"),
                (open_ | (conflict & ~one)).alias("conflict"),
                how.alias("confidence"),
                basis.alias("basis"),
                F.when(open_, sides).alias("disagreement"),
                mentions.alias("mentions"),
            )

        return let(confidence, result)

    return let(F.struct(presences.alias("presences"), F.filter(mentions, lambda m: m["authority"] == top).alias("winners")), decide)


def with_decisions(docs: DataFrame, kinds: Sequence[str] = ("condition",), authority: Mapping[str, int] = lexicon.SECTION_AUTHORITY) -> DataFrame:
    """docs (with entities and sections) with decisions, by concept, n_concepts, n_conflicts and n_unresolved, and policy, what is done about conflicts. authority ranks sections.

    Mentions of one concept by different experiencers are different findings. Everything stays in the document's row.
    """
    mentions = F.transform(F.filter("entities", lambda e: e["kind"].isin(*kinds)), lambda e: _mention(e, authority))
    out = docs.withColumn("__mentions", mentions)
    # Decisions of one concept follow the first mention of each experiencer, as a stable sort by concept leaves them.
    keys = F.array_distinct(F.transform("__mentions", lambda m: F.struct(m["concept"].alias("concept"), m["experiencer"].alias("experiencer"))))
    grouped = F.transform(keys, lambda k: F.filter("__mentions", lambda m: (m["concept"] == k["concept"]) & (m["experiencer"] == k["experiencer"])))
    placed = F.array_sort(F.transform(grouped, lambda g, i: F.struct(F.get(g, F.lit(0))["concept"].alias("concept"), i.alias("i"), g.alias("g"))), lambda a, b: F.when(a["concept"] < b["concept"], -1).when(a["concept"] > b["concept"], 1).otherwise(a["i"] - b["i"]))
    out = out.withColumn("decisions", F.transform(F.transform(placed, lambda x: x["g"]), _decision)).drop("__mentions")
    return out.withColumns({"n_concepts": F.size("decisions"), "n_conflicts": F.size(F.filter("decisions", lambda d: d["conflict"])), "n_unresolved": F.size(F.filter("decisions", lambda d: d["confidence"] == "unresolved")), "policy": F.lit(POLICY)})


def decisions(docs: DataFrame, key: str = "note_id") -> DataFrame:
    """A row per decision of docs (with_decisions)."""
    return docs.select(key, F.inline_outer("decisions")).where("concept is not null")


def rows(docs: DataFrame, key: str = "note_id", include_unresolved: bool = False) -> DataFrame:
    """A row per decision: concept, experiencer, presence, temporality, confidence, n_mentions, conflict; unresolved ones only if asked for."""
    out = decisions(docs, key).select(key, "concept", "experiencer", "presence", "temporality", "confidence", "n_mentions", "conflict")
    return out if include_unresolved else out.where("confidence <> 'unresolved'")
