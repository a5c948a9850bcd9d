"""Assertion scopes of a sentence and the three axes they set: presence, experiencer, temporality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions.text import asked, index_of, let, phrase_spans, places

LETTER = "a-z"
SCOPE = "array<struct<label:string,a:int,b:int>>"
#: Characters that stand for a masked phrase and a consumed trigger; no trigger or word has them.
MASKED, CONSUMED = "\x01", "\x02"

#: Triggers by the text they are looked for in: masked (pseudo-negations hidden), rest (forward negations hidden too, nothing else) and raw.
ON_MASKED = (("absent", "fwd", lexicon.NEGATION_FORWARD), ("absent", "bwd", lexicon.NEGATION_BACKWARD))
ON_REST = (
    ("family", "fwd", lexicon.FAMILY),
    ("historical", "fwd", lexicon.HISTORICAL),
    ("hypothetical", "fwd", lexicon.HYPOTHETICAL),
    ("possible", "fwd", lexicon.POSSIBLE),
    ("historical", "bwd", lexicon.HISTORICAL_BACKWARD),
    ("hypothetical", "bwd", lexicon.HYPOTHETICAL_BACKWARD),
)
ON_RAW = (("possible", "bwd", lexicon.POSSIBLE_BACKWARD),)


#: The above and terminations by source.
_SOURCES = {"masked": ON_MASKED, "rest": ON_REST, "raw": ON_RAW, "stop": ((None, None, lexicon.TERMINATION),)}
_NAMED = ("label", "dir", "source")
#: Beginnings of pseudo-negations: a text without any of them has none.
_PSEUDO = tuple(dict.fromkeys(p[:4] for p in lexicon.PSEUDO_NEGATION))


def _table(*sources: str) -> Column:
    rows = [(p, label, way, source) for source in sources for label, way, phrases in _SOURCES[source] for p in dict.fromkeys(phrases)]
    return index_of(rows, ("phrase", *_NAMED), LETTER)


def _of(found: Column, *sources: str) -> Column:
    return F.filter(found, lambda x: x["source"].isin(*sources))


def mask(low: Column) -> Column:
    """Pseudo-negations hidden, wherever they stand, one phrase after another."""
    hidden = reduce(lambda s, p: F.replace(s, F.lit(p), F.lit(MASKED * len(p))), lexicon.PSEUDO_NEGATION, low)
    return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in _PSEUDO)), hidden).otherwise(low)


def consume(low: Column, spans: Column) -> Column:
    return F.aggregate(spans, low, lambda s, x: F.call_function("overlay", s, F.repeat(F.lit(CONSUMED), x["e"] - x["s"]), x["s"] + 1, x["e"] - x["s"]))


def _ordered(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))


def trigger_spans(low: Column) -> Column:
    """array<struct<s, e>>: each place of any trigger of any axis, distinct, in order."""
    return _ordered(phrase_spans(low, _table("masked", "rest"), LETTER))


def _opened(spans: Column, stops: Column, length: Column) -> Column:
    """Scopes of trigger spans, up to the next termination or back to the one before."""

    def scope(x: Column) -> Column:
        after = F.coalesce(F.array_min(F.transform(F.filter(stops, lambda t: t["s"] >= x["e"]), lambda t: t["s"])), length)
        before = F.coalesce(F.array_max(F.transform(F.filter(stops, lambda t: t["e"] <= x["s"]), lambda t: t["e"])), F.lit(0))
        forward = x["dir"] == "fwd"
        return F.struct(x["label"].alias("label"), F.when(forward, x["e"]).otherwise(before).alias("a"), F.when(forward, after).otherwise(x["s"]).alias("b"), forward.alias("forward"))

    return F.transform(spans, scope)


def _bounded(scopes: Column, triggers: Column, low: Column) -> Column:
    """A scope ends where the next trigger starts (or starts where the one before ends) if a comma or semicolon lies between."""

    def apart(a: Column, b: Column) -> Column:
        return F.substring(low, a + 1, b - a).rlike("[,;]")

    def bound(x: Column) -> Column:
        next_ = F.get(F.filter(triggers, lambda t: (t["s"] >= x["a"]) & apart(x["a"], t["s"])), F.lit(0))["s"]
        last = F.get(F.reverse(F.filter(triggers, lambda t: (t["e"] <= x["b"]) & apart(t["e"], x["b"]))), F.lit(0))["e"]
        a = F.when(x["forward"], x["a"]).otherwise(F.greatest(x["a"], last))
        b = F.when(x["forward"], F.least(x["b"], next_)).otherwise(x["b"])
        return F.struct(x["label"].alias("label"), a.alias("a"), b.alias("b"))

    plain = F.transform(scopes, lambda x: F.struct(x["label"].alias("label"), x["a"].alias("a"), x["b"].alias("b")))
    return F.when(F.size(triggers) < 2, plain).otherwise(F.filter(F.transform(scopes, bound), lambda x: x["a"] < x["b"]))


def scopes(low: Column) -> Column:
    """array<struct<label, a, b>>: what each trigger of a lower-cased sentence covers."""
    table = _table(*_SOURCES)

    def spans(text: Column, rows: Column) -> Column:
        return places(text, rows, LETTER, _NAMED)

    def whole(rows: Column, plain: Column, masked: Column) -> Column:
        """From the sentence's rows of the table and their places; where nothing is hidden, those are the masked text's too."""

        def with_hidden(hidden: Column) -> Column:
            negations, stops = _of(hidden, "masked"), F.transform(_of(hidden, "stop"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

            def with_negations(found: Column) -> Column:
                rest = consume(low, F.filter(found, lambda x: x["dir"] == "fwd"))
                # Hidden phrases may have letters beside a trigger that is consumed: only then can the rest have words that the sentence has not.
                others = let(rest, lambda r: F.when(r == low, _of(plain, "rest")).when(masked == low, spans(r, _of(rows, "rest"))).otherwise(spans(r, _of(asked(r, table, LETTER), "rest"))))
                all_ = F.concat(found, others, _of(plain, "raw"))
                opened = let(stops, lambda stop: _opened(all_, stop, F.length(low)))
                return let(_ordered(_of(plain, "masked", "rest")), lambda triggers: let(opened, lambda o: _bounded(o, triggers, low)))

            return let(negations, with_negations)

        return let(F.when(masked == low, plain).otherwise(spans(masked, asked(masked, table, LETTER))), with_hidden)

    def with_rows(rows: Column) -> Column:
        made = let(spans(low, rows), lambda plain: let(mask(low), lambda masked: whole(rows, plain, masked)))
        # Without any phrase in the sentence, hiding some leaves none.
        return F.when((F.size(rows) == 0) & (mask(low) == low), F.array().cast(SCOPE)).otherwise(made)

    return let(asked(low, table, LETTER), with_rows)


def axes(labels: Column) -> Column:
    """struct<presence, experiencer, temporality, assertion, assertion_source> from the labels that cover a finding."""

    def of(found: Column) -> Column:
        def has(label: str) -> Column:
            return F.array_contains(found, label)

        presence = F.when(has("absent"), "absent").when(has("possible"), "possible").otherwise("present")
        temporality = F.when(has("historical"), "historical").when(has("hypothetical"), "hypothetical").otherwise("current")
        experiencer = F.when(has("family"), "family").otherwise("patient")
        three = F.struct(presence.alias("presence"), experiencer.alias("experiencer"), temporality.alias("temporality"))
        source = F.when(F.size(found) > 0, "sentence").otherwise("default")
        return let(three, lambda x: F.struct(*(x[n].alias(n) for n in ("presence", "experiencer", "temporality")), collapse(x["presence"], x["experiencer"], x["temporality"]).alias("assertion"), source.alias("assertion_source")))

    return let(labels, of)


def collapse(presence: Column, experiencer: Column, temporality: Column) -> Column:
    """One label of three axes: the experiencer first, then presence, then temporality."""
    return F.when(experiencer == "family", "family").when(presence.isin("absent", "possible"), presence).when(temporality.isin("historical", "hypothetical"), temporality).otherwise("present")
