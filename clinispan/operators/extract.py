"""Documents to entities: one narrow projection, without a shuffle, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions import context, sections, text
from clinispan.functions.text import map_of

KINDS = ("condition", "medication", "allergy")
#: The dictionaries by kind: phrases by concept.
DICTIONARIES = {"condition": lexicon.CONDITION_TERMS, "medication": lexicon.MEDICATION_TERMS, "allergy": lexicon.ALLERGEN_TERMS}
#: The terminologies by kind: their name, and (code, display) by concept.
TERMINOLOGIES = {"condition": ("SNOMED-CT", lexicon.SNOMED), "medication": ("RxNorm", lexicon.RXNORM)}
_HIT = "array<struct<s:int,e:int,kind:string,concept:string>>"


def _hits(low: Column, dictionaries: Mapping[str, Mapping[str, Sequence[str]]] = DICTIONARIES) -> Column:
    """Matches of the three dictionaries; allergens only where the sentence speaks of allergies."""
    # One table, so that the words of a sentence are looked up once.
    rows = [(phrase, concept, kind) for kind in KINDS for phrase, concept in sorted(lexicon.pairs(dictionaries[kind]), key=lambda x: -len(x[0]))]

    def of(hits: Column, kind: str) -> Column:
        return F.array_sort(F.filter(hits, lambda h: h["kind"] == kind))

    def free(found: Column) -> Column:
        spoken = F.filter(found, lambda h: (h["kind"] != "allergy") | low.rlike(text.ALLERGY_CONTEXT))
        return text.let(text.apart(spoken, _HIT, lambda a, b: a["kind"] == b["kind"]), lambda hits: F.concat(*(of(hits, kind) for kind in KINDS)))

    spans = text.phrase_spans(low, text.index_of(rows, ("phrase", "concept", "kind"), text.TERM), text.TERM, ("kind", "concept"))
    return text.let(spans, lambda found: F.when(F.size(found) == 0, F.array().cast(_HIT)).otherwise(free(found)))


def _code(kind: Column, concept: Column, terminologies: Mapping[str, tuple[str, Mapping[str, tuple[str, str]]]]) -> Column:
    """struct<code_system, code, code_display>, nulls for a concept without a code."""
    table = map_of({f"{k}/{c}": f"{s}\0{code}\0{show}" for k, (s, codes) in terminologies.items() for c, (code, show) in codes.items()})
    parts = F.split(F.try_element_at(table, F.concat(kind, F.lit("/"), concept)), "\0")
    return text.let(parts, lambda found: F.struct(*(F.get(found, F.lit(i)).alias(n) for i, n in enumerate(("code_system", "code", "code_display")))))


def _entities(sentence: Column, sent_id: Column, terminologies: Mapping[str, tuple[str, Mapping[str, tuple[str, str]]]]) -> Column:
    def entity(hit: Column) -> Column:
        labels = F.transform(F.filter(sentence["scopes"], lambda x: (x["a"] <= hit["s"]) & (hit["e"] <= x["b"])), lambda x: x["label"])
        found = F.struct(sent_id.alias("sent_id"), (sentence["start"] + hit["s"]).alias("start"), (sentence["start"] + hit["e"]).alias("end"), F.substring(sentence["text"], hit["s"] + 1, hit["e"] - hit["s"]).alias("text"), hit["kind"].alias("kind"), hit["concept"].alias("concept"))
        attributes = F.when(hit["kind"] == "medication", text.medication_attributes(sentence["text"], hit["e"]))
        empty = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("dose", "route", "frequency")))
        parts = F.struct(found.alias("f"), context.axes(labels).alias("x"), F.coalesce(attributes, empty).alias("m"), _code(hit["kind"], hit["concept"], terminologies).alias("c"))
        return text.let(parts, lambda p: F.struct(*(p["f"][n].alias(n) for n in ("sent_id", "start", "end", "text", "kind", "concept")), *(p["x"][n].alias(n) for n in ("presence", "experiencer", "temporality", "assertion", "assertion_source")), p["m"].alias("attrs"), *(p["c"][n].alias(n) for n in ("code_system", "code", "code_display"))))

    return F.transform(sentence["hits"], entity)


def _by_start(a: Column, b: Column) -> Column:
    rank = map_of({k: i for i, k in enumerate(KINDS)})
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.element_at(rank, a["kind"]) - F.element_at(rank, b["kind"]))


def with_sentences(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with sentences array<struct<text, start, end>>; none for null."""
    return docs.withColumn("sentences", text.sentences(F.coalesce(F.col(column), F.lit(""))))


def with_entities(docs: DataFrame, column: str = "text", keep_stages: bool = False, dictionaries: Mapping = DICTIONARIES, terminologies: Mapping = TERMINOLOGIES) -> DataFrame:
    """docs with entities, an array in the order of their starts (conditions, medications, allergies where these are equal).

    Scopes are computed for sentences with a match only. keep_stages keeps the columns sentences and matched (sentences
    with hits, masked text's scopes and triggers), from which the views of operators.views come. dictionaries and terminologies by
    kind stand in for those of the package; each of KINDS needs a dictionary, if an empty one.
    """
    out = with_sentences(docs, column)
    found = F.transform("sentences", lambda s, i: text.let(F.lower(s["text"]), lambda low: F.struct(i.alias("sent_id"), s["text"].alias("text"), s["start"].alias("start"), low.alias("low"), _hits(low, dictionaries).alias("hits"))))
    out = out.withColumn("matched", F.filter(found, lambda s: F.size(s["hits"]) > 0))
    out = out.withColumn("matched", F.transform("matched", lambda s: F.struct(*(s[n].alias(n) for n in ("sent_id", "text", "start", "low", "hits")), context.scopes(s["low"]).alias("scopes"))))
    out = out.withColumn("entities", F.array_sort(F.flatten(F.transform("matched", lambda s: _entities(s, s["sent_id"], terminologies))), _by_start))
    return out if keep_stages else out.drop("sentences", "matched")


def with_sections(docs: DataFrame, column: str = "text", kinds: Sequence[str] = ("condition",), apply: bool = True, defaults: Mapping[str, str] = lexicon.SECTION_DEFAULT) -> DataFrame:
    """docs (with entities) with sections, and with apply also section_changes: findings of kinds that no sentence qualifies take the assertion that their section implies.

    Only assertion changes; the axes and assertion_source stay as the sentence left them. Each entity gains section and
    section_default (what the section set, else null).
    """
    out = docs.withColumn("sections", sections.section_spans(F.coalesce(F.col(column), F.lit(""))))

    def placed(e: Column, spans: Column) -> Column:
        def filled(section: Column) -> Column:
            default = F.when(e["kind"].isin(*kinds) & (e["assertion"] == "present"), sections.section_default(section, defaults)) if apply else F.lit(None).cast("string")
            return text.let(default, lambda d: e.withField("section", section).withField("section_default", d).withField("assertion", F.coalesce(d, e["assertion"])))

        return text.let(sections.section_at(spans, e["start"]), filled)

    # Held outside, as sections would else be made for each entity.
    out = out.withColumn("entities", text.let(F.col("sections"), lambda spans: F.transform("entities", lambda e: placed(e, spans))))
    changed = F.filter("entities", lambda e: e["section_default"].isNotNull())
    return out.withColumn("section_changes", F.transform(changed, lambda e: F.struct(e["text"].alias("text"), e["start"].alias("start"), e["concept"].alias("concept"), F.lit("present").alias("from"), e["section_default"].alias("to"), e["section"].alias("section"))))


def extract_documents(docs: DataFrame, column: str = "text", sections: bool = True) -> DataFrame:
    """docs with entities, n_entities, sections and section_changes (empty without sections)."""
    out = with_sections(with_entities(docs, column), column, apply=sections)
    return out.withColumn("n_entities", F.size("entities"))
