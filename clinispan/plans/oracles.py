"""SQL for DuckDB that computes the extraction another way: every position of every phrase by joins, then filters.

The engine walks lexicons within a row; these statements join sentences with lexicon tables, so that agreement means something. They rely on
three traits of the synthetic notes: one space between sentences, no chains of overlapping dictionary matches, and ASCII text.
"""

from __future__ import annotations

from clinispan import lexicon
from clinispan.functions import context
from clinispan.operators import fhir, reconcile
from clinispan.plans.queries import GENERATED
from clinispan.sources.notes import notes_sql


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else _quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _nested(start: str, steps) -> str:
    for step in steps:
        start = step(start)
    return start


# The patterns once more, so that a wrong one in the engine shows.
_DOSE = _quote(r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|g|units?|ml|iu)\b")
_ROUTE = _quote(r"(?i)\b(po|by mouth|orally|iv|intravenous(?:ly)?|im|sublingual|sl|subcutaneous(?:ly)?|subq|sc|inhaled|nebulized|topical|pr|rectally|transdermal)\b")
_FREQUENCY = _quote(r"(?i)\b(qd|q\.?d\.?|daily|once daily|bid|b\.?i\.?d\.?|twice daily|tid|t\.?i\.?d\.?|three times daily|qid|q\.?i\.?d\.?|four times daily|qhs|nightly|at bedtime|weekly|every other day|q\d+h|every \d+ hours|prn|as needed)\b")
_ALLERGY = "allerg|adverse reaction|intoleran"


def _chain(table: str, key: str, patient: str) -> list[tuple[str, str]]:
    guarded = _nested("text", [lambda s, w=w: f"replace({s}, {_quote(w)}, {_quote(w.replace('.', '@'))})" for w in lexicon.ABBREVIATIONS])
    marked = _nested("p", [lambda s, c=c: f"replace({s}, {_quote(c + ' ')}, {_quote(c)} || chr(3))" for c in ".!?;"])
    masked = _nested("low", [lambda s, w=w: f"replace({s}, {_quote(w)}, repeat(chr(1), {len(w)}))" for w in lexicon.PSEUDO_NEGATION])
    groups = [("masked", context.ON_MASKED), ("rest", context.ON_REST), ("raw", context.ON_RAW)]
    triggers = [(p, label, way, src) for src, gs in groups for label, way, ps in gs for p in dict.fromkeys(ps)]
    phrases = sorted({p for _, gs in groups[:2] for _, _, ps in gs for p in ps})
    terms = [(p, kind, c) for kind, t in (("condition", lexicon.CONDITION_TERMS), ("medication", lexicon.MEDICATION_TERMS), ("allergy", lexicon.ALLERGEN_TERMS)) for p, c in lexicon.pairs(t)]
    codes = [(k, c, s, code, show) for k, s, t in (("condition", "SNOMED-CT", lexicon.SNOMED), ("medication", "RxNorm", lexicon.RXNORM)) for c, (code, show) in t.items()]
    names = "|".join(sorted((n for n, _ in lexicon.pairs(lexicon.SECTION_ALIASES)), key=len, reverse=True))

    def places(src: str, lex: str, word: str, extra: str) -> str:
        """All places of lex's phrases in src(sent, t), by the first characters at each place where a word may begin."""
        return f"""select s.sent, s.p - 1 as s, s.p - 1 + length(l.phrase) as e, {extra} from
          (select sent, t, unnest(range(1, length(t) + 1)) as p from {src}) s join {lex} l on substr(s.t, s.p, length(l.phrase)) = l.phrase
          where (s.p = 1 or not regexp_matches(substr(s.t, s.p - 1, 1), '[{word}]')) and not regexp_matches(substr(s.t, s.p + length(l.phrase), 1), '[{word}]')"""

    return [
        ("notes", notes_sql(table, key, patient)),
        ("guarded", f"select note_id, patient_id, text, {guarded} as p from notes"),
        ("chunks", f"select note_id, text, unnest(string_split(replace({marked}, chr(10), chr(3)), chr(3))) as c, generate_subscripts(string_split(replace({marked}, chr(10), chr(3)), chr(3)), 1) as i from guarded"),
        ("placed", "select note_id, text, c, i, sum(length(c) + 1) over (partition by note_id order by i) - length(c) - 1 as start from chunks"),
        ("sentences", "select note_id, cast(row_number() over (partition by note_id order by i) - 1 as integer) as sent_id, substr(text, cast(start + 1 as bigint), length(c)) as text, cast(start as integer) as start, cast(start + length(c) as integer) as \"end\" from placed where trim(c, ' ' || chr(9) || chr(10)) <> ''"),
        # Each distinct sentence is worked on once.
        ("texts", f"select *, {masked} as masked from (select row_number() over () as sent, low, original from (select distinct lower(text) as low, text as original from sentences))"),
        ("term", f"select * from (values {_values(terms)}) t(phrase, kind, concept)"),
        ("trigger", f"select * from (values {_values(triggers)}) t(phrase, label, way, src)"),
        ("stop", f"select * from (values {_values([(p,) for p in lexicon.TERMINATION])}) t(phrase)"),
        ("anytrigger", f"select * from (values {_values([(p,) for p in phrases])}) t(phrase)"),
        ("code", f"select * from (values {_values(codes)}) t(kind, concept, code_system, code, code_display)"),
        ("low_t", "select sent, low as t from texts"),
        ("masked_t", "select sent, masked as t from texts"),
        ("allhits", places("low_t", "term", "a-z0-9", "l.kind, l.concept")),
        ("hits", f"select h.* from allhits h join texts x using (sent) where (kind <> 'allergy' or regexp_matches(low, {_quote(_ALLERGY)})) and not exists (select 1 from allhits o where o.sent = h.sent and o.kind = h.kind and o.s < h.e and h.s < o.e and o.e - o.s > h.e - h.s)"),
        ("stops", places("masked_t", "stop", "a-z", "0 as z")),
        ("raw_places", places("low_t", "trigger", "a-z", "l.label, l.way, l.src")),
        ("masked_places", places("masked_t", "trigger", "a-z", "l.label, l.way, l.src")),
        ("consumed", "select sent, s, e from masked_places where src = 'masked' and way = 'fwd'"),
        ("opened", "select sent, s, e, label, way from masked_places where src = 'masked' union all select sent, s, e, label, way from raw_places where src = 'raw' union all select sent, s, e, label, way from raw_places r where src = 'rest' and not exists (select 1 from consumed c where c.sent = r.sent and c.s < r.e and r.s < c.e)"),
        ("alltriggers", f"select distinct sent, s, e from ({places('low_t', 'anytrigger', 'a-z', '0 as z')})"),
        ("ranged", """select o.sent, o.label, o.way, o.s, o.e, case when way = 'fwd' then o.e else coalesce((select max(t.e) from stops t where t.sent = o.sent and t.e <= o.s), 0) end as a,
          case when way = 'fwd' then coalesce((select min(t.s) from stops t where t.sent = o.sent and t.s >= o.e), length(x.low)) else o.s end as b, x.low from opened o join texts x using (sent)"""),
        ("scopes", """select r.sent, r.label, case when way = 'bwd' then greatest(a, coalesce((select arg_max(t.e, t.s * 100000 + t.e) from alltriggers t where t.sent = r.sent and t.e <= r.b and regexp_matches(substr(r.low, t.e + 1, r.b - t.e), '[,;]')), a)) else a end as a,
          case when way = 'fwd' then least(b, coalesce((select min(t.s) from alltriggers t where t.sent = r.sent and t.s >= r.a and regexp_matches(substr(r.low, r.a + 1, t.s - r.a), '[,;]')), b)) else b end as b from ranged r"""),
        ("labelled", "select h.sent, h.s, h.e, h.kind, h.concept, coalesce(bool_or(c.label = 'absent'), false) as ab, coalesce(bool_or(c.label = 'possible'), false) as po, coalesce(bool_or(c.label = 'family'), false) as fa, coalesce(bool_or(c.label = 'historical'), false) as hi, coalesce(bool_or(c.label = 'hypothetical'), false) as hy, count(c.label) as n from hits h left join scopes c on c.sent = h.sent and c.a <= h.s and h.e <= c.b group by all"),
        ("axes", "select *, case when ab then 'absent' when po then 'possible' else 'present' end as presence, case when fa then 'family' else 'patient' end as experiencer, case when hi then 'historical' when hy then 'hypothetical' else 'current' end as temporality, case when fa then 'family' when ab then 'absent' when po then 'possible' when hi then 'historical' when hy then 'hypothetical' else 'present' end as assertion, case when n > 0 then 'sentence' else 'default' end as assertion_source from labelled"),
        ("windowed", f"select a.*, x.original, substr(x.original, a.e + 1, 60) as w from axes a join texts x using (sent)"),
        ("attributed", f"""select *, case when kind = 'medication' then nullif(lower(regexp_extract(w, {_ROUTE}, 1)), '') end as route, case when kind = 'medication' then nullif(lower(regexp_extract(w, {_FREQUENCY}, 1)), '') end as frequency,
          case when kind = 'medication' and regexp_matches(w, {_DOSE}) and not (regexp_matches(w, '\\b(and|,|;)\\s+[a-z]') and length(string_split_regex(w, {_DOSE})[1]) > length(string_split_regex(w, '\\b(and|,|;)\\s+[a-z]')[1])) then regexp_extract(w, {_DOSE}, 1) || ' ' || lower(regexp_extract(w, {_DOSE}, 2)) end as dose from windowed"""),
        ("lines", "select note_id, l, i, sum(length(l) + 1) over (partition by note_id order by i) - length(l) - 1 as place from (select note_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from notes)"),
        ("heads", f"select note_id, place, place + length(regexp_extract(l, '(?i)^[ \\t]*({names})[ \\t]*:')) as body, lower(regexp_extract(l, '(?i)^[ \\t]*({names})[ \\t]*:', 1)) as name from lines where regexp_matches(l, '(?i)^[ \\t]*({names})[ \\t]*:')"),
        ("alias", f"select * from (values {_values(lexicon.pairs(lexicon.SECTION_ALIASES))}) t(name, section)"),
        ("bodies", "select h.note_id, a.section, body as start, coalesce(lead(place) over (partition by h.note_id order by place), length(n.text)) as \"end\" from heads h join alias a using (name) join notes n on n.note_id = h.note_id"),
        ("sections", "select note_id, cast(row_number() over (partition by note_id order by start, \"end\") - 1 as integer) as ord, section, cast(start as integer) as start, cast(\"end\" as integer) as \"end\" from (select * from bodies union all select n.note_id, 'preamble', 0, coalesce(min(place), max(length(text))) from notes n left join heads h on h.note_id = n.note_id group by n.note_id having coalesce(min(place), 1) > 0)"),
        ("found", """select q.note_id, q.sent_id, cast(q.start + a.s as integer) as start, cast(q.start + a.e as integer) as "end", substr(a.original, a.s + 1, a.e - a.s) as text, a.kind, a.concept, presence, experiencer, temporality, assertion, assertion_source, code_system, code, code_display, dose, route, frequency
          from sentences q join attributed a on a.original = q.text left join code using (kind, concept)"""),
        ("sited", "select f.*, coalesce(x.section, 'preamble') as section from found f left join sections x on x.note_id = f.note_id and x.start <= f.start and f.start < x.\"end\""),
        ("defaults", f"select * from (values {_values(lexicon.SECTION_DEFAULT.items())}) t(section, default_)"),
        ("layered", "select s.*, case when kind = 'condition' and assertion = 'present' then default_ end as section_default, coalesce(case when kind = 'condition' and assertion = 'present' then default_ end, assertion) as layered from sited s left join defaults using (section)"),
        ("authority", f"select * from (values {_values(lexicon.SECTION_AUTHORITY.items())}) t(section, authority)"),
        ("mentions", f"select l.*, coalesce(authority, {lexicon.OTHER_AUTHORITY}) as authority from layered l left join authority using (section) where kind = 'condition'"),
        ("grouped", "select *, max(authority) over (partition by note_id, concept, experiencer) as top from mentions"),
        ("judged", "select note_id, concept, experiencer, count(*) as n, count(distinct presence) > 1 as conflict, bool_or(presence = 'absent') and count(distinct presence) > 1 as denied, count(*) filter (authority = top) as winners, count(distinct presence) filter (authority = top) as sides, arg_min(presence, start) filter (authority = top) as presence, arg_min(temporality, start) filter (authority = top) as temporality, arg_min(section, start) filter (authority = top) as section, max(top) as top from grouped group by note_id, concept, experiencer"),
        ("confident", "select *, case when n = 1 then 'single' when winners = 1 and not denied then 'authoritative' when sides = 1 and not denied then 'agreed' else 'unresolved' end as confidence from judged"),
        ("decided", f"""select note_id, concept, experiencer, case when confidence <> 'unresolved' then presence end as presence, case when confidence <> 'unresolved' then temporality end as temporality, cast(n as integer) as n_mentions, confidence = 'unresolved' or conflict as conflict, confidence,
          case confidence when 'single' then {_quote(reconcile.BASIS_SINGLE)} when 'authoritative' then 'the ' || section || ' mention outranks the others (authority ' || top || ')' when 'agreed' then {_quote(reconcile.BASIS_AGREED)} else case when denied and winners > 1 then {_quote(reconcile.BASIS_TIED)} else {_quote(reconcile.BASIS_OPEN)} end end as basis from confident"""),
        # Requests: by the note's id, single, batch of the text and a blank one, elsewhere, broken, single.
        ("requests", "select cast(note_id as varchar) as request_id, note_id % 5 as kind, (select count(*) from found f where f.note_id = n.note_id) as n_entities from notes n"),
        ("answers", "select request_id, 0 as ord, case when kind = 1 then 'a' else '0' end as id, true as ok, cast(null as varchar) as error, n_entities from requests where kind in (0, 1, 4) union all select request_id, 1, '1', false, 'empty or non-string text', null from requests where kind = 1"),
        # Scores: the sections' results are expected, the sentences' predicted; of each triple, as many as both sides have match.
        ("sided", "select note_id, concept, kind, start, text, layered as wanted, case when section_default is not null then 'present' else layered end as given from layered"),
        ("wanted", "select note_id, concept, kind, wanted as assertion, start, row_number() over (partition by note_id, concept, kind, wanted order by start) as k from sided"),
        ("given", "select note_id, concept, kind, given as assertion, start, row_number() over (partition by note_id, concept, kind, given order by start) as k from sided"),
        ("left_wanted", "select note_id, concept, kind, assertion, row_number() over (partition by note_id, concept, kind order by start) as r from wanted w anti join given g using (note_id, concept, kind, assertion, k)"),
        ("left_given", "select note_id, concept, kind, assertion, row_number() over (partition by note_id, concept, kind order by start) as r from given g anti join wanted w using (note_id, concept, kind, assertion, k)"),
        ("outcomes", "select note_id as case_id, concept, kind, assertion as expected, assertion as got, 'exact' as outcome from wanted semi join given using (note_id, concept, kind, assertion, k) union all select note_id, concept, kind, w.assertion, g.assertion, case when g.assertion is null then 'missed' when w.assertion is null then 'spurious' else 'wrong_assertion' end from left_wanted w full join left_given g using (note_id, concept, kind, r)"),
        ("generated", f"select phrase, min(k) as ord, cast(min(k) as varchar) as concept from (select o_orderkey as k, {GENERATED.duckdb('o_orderkey')} || ' ' || case o_orderkey % 10 when 0 then 'today' when 1 then 'and' else cast(o_orderkey as varchar) end as phrase from orders) group by phrase"),
        ("generated_hits", """select sent, s, s + n as e, phrase, concept from (select sent, p - 1 as s, n, low, substr(low, cast(p as bigint), n) as phrase from (select sent, low, unnest(range(1, length(low) + 1)) as p from texts), (select distinct length(phrase) as n from generated)
          where p = 1 or not regexp_matches(substr(low, p - 1, 1), '[a-z0-9]')) join generated using (phrase) where not regexp_matches(substr(low, s + n + 1, 1), '[a-z0-9]')"""),
        ("numbered", "select l.*, cast(row_number() over (partition by note_id order by start, case kind when 'condition' then 0 when 'medication' then 1 else 2 end) as integer) as n, n2.patient_id from layered l join notes n2 using (note_id)"),
    ]


_ENTITY = "note_id, sent_id, start, \"end\", text, kind, concept, presence, experiencer, temporality"
_STATUS = "case layered when 'present' then 'active' when 'historical' then 'resolved' when 'possible' then 'active' end"

#: Query by name: its columns from the chain above.
FINAL = {
    "synth_notes": "select note_id, patient_id, text from notes",
    "sentences": "select note_id, sent_id, text, start, \"end\" from sentences",
    "trigger_hits": "select q.note_id, q.sent_id, cast(s as integer) as start, cast(e as integer) as \"end\" from sentences q join texts x on x.original = q.text join alltriggers t using (sent)",
    "scopes": "select q.note_id, q.sent_id, c.label, cast(a as integer) as start, cast(b as integer) as \"end\" from sentences q join texts x on x.original = q.text join scopes c using (sent) where exists (select 1 from hits h where h.sent = x.sent) and a < b",
    "condition_entities": "select note_id, start, \"end\", text, concept from found where kind = 'condition'",
    "negated_entities": "select note_id, start, text, kind, concept, experiencer, temporality from found where presence = 'absent'",
    "entity_axes": f"select {_ENTITY}, assertion, assertion_source from found",
    "assertion_counts": "select kind, assertion, count(*) as n from found group by all",
    "med_attrs": "select note_id, start, concept, dose, route, frequency from found where kind = 'medication'",
    "allergies": "select note_id, start, text, concept, assertion from found where kind = 'allergy'",
    "coded_entities": "select note_id, start, kind, concept, code_system, code, code_display from found",
    "mapping_hit_rate": "select count(*) as n_concepts, count(code) as n_mapped, round(count(code) / count(*), 6) as hit_rate from (select kind, concept, max(code) as code from found where kind <> 'allergy' group by all)",
    "mapping_misses": "select kind, concept, count(*) as n from found where kind <> 'allergy' and code is null group by all",
    "section_spans": "select note_id, ord, section, start, \"end\" from sections",
    "entity_sections": "select note_id, start, kind, concept, section from sited",
    "section_defaults": "select note_id, start, kind, concept, layered as assertion, section_default from layered",
    "section_audit": "select note_id, text, start, concept, 'present' as \"from\", section_default as \"to\", section from layered where section_default is not null",
    "reconcile_decisions": "select note_id, concept, experiencer, presence, temporality, n_mentions, conflict, confidence, basis from decided",
    "reconcile_rows": "select note_id, concept, experiencer, presence, temporality, confidence, n_mentions, conflict from decided where confidence <> 'unresolved'",
    "reconcile_all_rows": "select note_id, concept, experiencer, presence, temporality, confidence, n_mentions, conflict from decided",
    "reconcile_counts": "select note_id, count(*) as n_concepts, count(*) filter (conflict) as n_conflicts, count(*) filter (confidence = 'unresolved') as n_unresolved from decided group by note_id",
    "reconcile_disagreements": "select distinct note_id, concept, experiencer, section, presence from grouped g join (select note_id, concept, experiencer from decided where confidence = 'unresolved') using (note_id, concept, experiencer)",
    "fhir_conditions": f"select note_id || '-' || n as id, 'Patient/' || patient_id as subject, text, code, {_STATUS} as clinical_status, case layered when 'possible' then 'provisional' when 'absent' then 'refuted' else 'confirmed' end as verification_status from numbered where kind = 'condition' and layered not in ('family', 'hypothetical')",
    "fhir_medications": "select note_id || '-' || n as id, text, code, case layered when 'present' then 'active' when 'historical' then 'completed' when 'absent' then 'not-taken' when 'hypothetical' then 'active' else 'unknown' end as status, cast(string_split(dose, ' ')[1] as double) as dose_value, string_split(dose, ' ')[2] as dose_unit, route, frequency, case when layered = 'hypothetical' or frequency in ('prn', 'as needed') then true end as as_needed from numbered where kind = 'medication'",
    "fhir_allergies": "select note_id || '-' || n as id, 'Patient/' || patient_id as patient, text, 'active' as clinical_status, 'confirmed' as verification_status, assertion from numbered where kind = 'allergy'",
    "fhir_family": "select note_id || '-fmh' as id, n_conditions, first_text from (select note_id, count(*) as n_conditions, arg_min(text, n) as first_text from numbered where kind = 'condition' and layered = 'family' group by note_id)",
    "fhir_dropped": f"select cast(note_id as varchar) as note_id, text, 'hypothetical' as assertion, {_quote(fhir.DROPPED_REASON)} as reason from numbered where kind = 'condition' and layered = 'hypothetical'",
    "fhir_type_counts": "select type, count(*) as n from (select case when kind = 'medication' then 'MedicationStatement' when kind = 'allergy' then 'AllergyIntolerance' else 'Condition' end as type from numbered where kind <> 'condition' or layered not in ('family', 'hypothetical') union all select distinct 'FamilyMemberHistory' as type from numbered where false union all select 'FamilyMemberHistory' from (select distinct note_id from numbered where kind = 'condition' and layered = 'family')) group by type",
    "fhir_bundle_sizes": "select cast(x.note_id as varchar) as note_id, cast(count(n) filter (kind <> 'condition' or layered not in ('family', 'hypothetical')) + max(case when kind = 'condition' and layered = 'family' then 1 else 0 end) as integer) as n_resources from notes x left join numbered y on x.note_id = y.note_id group by x.note_id",
    "fhir_lint": "select 0 as n_problems",
    "fhir_lint_broken": """select problem, count(*) as n from (
      select unnest(case n % 7 when 1 then ['no resourceType'] when 2 then case when type = 'Condition' then ['a Condition needs a subject'] end
        when 3 then case when type = 'Condition' then ['unknown verificationStatus ' || chr(39) || 'sure' || chr(39)] end
        when 4 then case type when 'MedicationStatement' then ['unknown status of a MedicationStatement ' || chr(39) || 'odd' || chr(39)] when 'FamilyMemberHistory' then ['unknown status of a FamilyMemberHistory'] end
        when 5 then case when type = 'FamilyMemberHistory' then ['a FamilyMemberHistory needs a relationship'] end when 6 then case when type = 'MedicationStatement' then ['a MedicationStatement names no medication'] end end) as problem
      from (select n, case when kind = 'medication' then 'MedicationStatement' when kind = 'allergy' then 'AllergyIntolerance' else 'Condition' end as type from numbered where kind <> 'condition' or layered not in ('family', 'hypothetical')
        union all select max(n) + 1, 'FamilyMemberHistory' from numbered group by note_id having count(*) filter (kind = 'condition' and layered = 'family') > 0)) group by problem""",
    "request_status": "select case kind when 1 then '/extract/batch' when 2 then '/elsewhere' else '/extract' end as route, case kind when 2 then 404 when 3 then 400 else 200 end as status, case kind when 2 then 'NoSuchRoute' when 3 then 'InvalidJson' end as error_class, count(*) as n from requests group by all",
    "batch_results": "select request_id, ord, id, ok, error, cast(n_entities as integer) as n_entities from answers",
    "batch_summary": "select request_id, count(*) as n_documents, count(*) filter (not ok) as n_failed, cast(sum(coalesce(n_entities, 0)) as bigint) as n_entities from answers group by request_id",
    "safe_log": "select r.request_id, case kind when 1 then '/extract/batch' when 2 then 'other' else '/extract' end as route, case kind when 2 then 404 when 3 then 400 else 200 end as status, count(a.request_id) as n_documents, cast(coalesce(sum(a.n_entities), 0) as bigint) as n_entities, case kind when 2 then 'NoSuchRoute' when 3 then 'InvalidJson' end as error_class from requests r left join answers a using (request_id) group by r.request_id, kind",
    "gold_prf": """select n_cases, exact_case_match, tp as tp_exact, tp + w as tp_relaxed, fp, fn, round(tp / (tp + fp), 6) as exact_precision, round(tp / (tp + fn), 6) as exact_recall, round(2 * tp / (2 * tp + fp + fn), 6) as exact_f1,
      round((tp + w) / (tp + w + fp), 6) as relaxed_precision, round((tp + w) / (tp + w + fn), 6) as relaxed_recall, round(2 * (tp + w) / (2 * (tp + w) + fp + fn), 6) as relaxed_f1,
      round(tp / (tp + fp + w), 6) as strict_precision, round(tp / (tp + fn + w), 6) as strict_recall, round(2 * tp / (2 * tp + fp + fn + 2 * w), 6) as strict_f1
      from (select count(*) filter (outcome = 'exact') as tp, count(*) filter (outcome = 'wrong_assertion') as w, count(*) filter (outcome = 'missed') as fn, count(*) filter (outcome = 'spurious') as fp from outcomes),
        (select count(*) as n_cases, count(*) filter (not exists (select 1 from outcomes o where o.case_id = n.note_id and outcome <> 'exact')) as exact_case_match from notes n)""",
    "gold_confusion": "select expected as true_assertion, " + ", ".join(f"count(*) filter (got = '{a}') as {a}" for a in lexicon.ASSERTIONS) + " from outcomes where outcome in ('exact', 'wrong_assertion') group by expected",
    "gold_errors": "select case_id, outcome, concept, kind, expected, got from outcomes where outcome <> 'exact'",
    "rule_classes": f"""select label, support, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round(accuracy, 6) as accuracy from (
      select label, count(*) filter (wanted = label) as support, count(*) filter (wanted = label and given = label) as tp, count(*) filter (wanted <> label and given = label) as fp, count(*) filter (wanted = label and given <> label) as fn, avg(case when wanted = given then 1.0 else 0.0 end) as accuracy
      from sided, (select unnest([{', '.join(f"'{a}'" for a in lexicon.ASSERTIONS)}]) as label) group by label) where support > 0 or fp > 0""",
    "phrase_hits": "select note_id, sent_id, h.kind, cast(h.s as integer) as s, cast(h.e as integer) as e, h.concept from sentences q join texts x on x.original = q.text join hits h using (sent)",
    "phrase_hits_generated": "select note_id, sent_id, cast(s as integer) as s, cast(e as integer) as e, phrase, concept from sentences q join texts x on x.original = q.text join generated_hits h using (sent) where not exists (select 1 from generated_hits o where o.sent = h.sent and o.s < h.e and h.s < o.e and o.e - o.s > h.e - h.s)",
    "gold_leakage": "select count(*) filter (expected = 'absent') as n_absent, count(*) filter (expected = 'absent' and got = 'present') as absent_to_present, count(*) filter (expected = 'family' and got = 'present') as family_to_present, round(count(*) filter (expected = 'absent' and got = 'present') / nullif(count(*) filter (expected = 'absent'), 0), 6) as absent_rate from outcomes where outcome in ('exact', 'wrong_assertion')",
    "patient_conditions": "select cast(note_id as varchar) as note_id, lower(text) as text from numbered where kind = 'condition' and layered not in ('family', 'hypothetical')",
    "fhir_bundle_entries": """select bundle_id, 'collection' as bundle_type, cast(row_number() over (partition by bundle_id order by n) - 1 as integer) as ord, resource_type, id, subject, text, code, cast(n_conditions as integer) as n_conditions from (
      select cast(note_id as varchar) as bundle_id, n, case kind when 'medication' then 'MedicationStatement' when 'allergy' then 'AllergyIntolerance' else 'Condition' end as resource_type, note_id || '-' || n as id, 'Patient/' || patient_id as subject, text, code, 0 as n_conditions from numbered where kind <> 'condition' or layered not in ('family', 'hypothetical')
      union all select cast(note_id as varchar), max(n) + 1, 'FamilyMemberHistory', note_id || '-fmh', 'Patient/' || any_value(patient_id), null, null, count(*) filter (kind = 'condition' and layered = 'family') from numbered group by note_id having count(*) filter (kind = 'condition' and layered = 'family') > 0)""",
    "service_totals": "select count(*) as n_documents, count(*) filter (not ok) as n_failed, cast(sum(coalesce(n_entities, 0)) as bigint) as n_entities from answers",
    "gold_confusion_margins": "select case when grouping(expected) = 1 then 'all' else expected end as true_assertion, case when grouping(got) = 1 then 'all' else got end as got, count(*) as n from outcomes where outcome in ('exact', 'wrong_assertion') group by cube (expected, got)",
    "section_summary": """select case when grouping(arguable) = 1 then 'all' when arguable then 'arguable' else 'core' end as set, count(*) as n, round(avg(without::int), 6) as without, round(avg(with_::int), 6) as "with", count(*) filter (with_ and not without) as fixed, count(*) filter (without and not with_) as broken, cast(sum(n_changes) as bigint) as n_changes
      from (select n.note_id % 5 = 0 as arguable, n_changes, n.note_id % 3 = 0 or n_changes = 0 as without, n.note_id % 3 <> 0 or n_changes = 0 as with_
        from notes n join (select x.note_id, count(l.section_default) as n_changes from notes x left join layered l using (note_id) group by x.note_id) using (note_id)) group by rollup (arguable)""",
    "family_leak": "select count(*) as n_leaks from numbered f where kind = 'condition' and layered = 'family' and exists (select 1 from numbered o where o.note_id = f.note_id and o.kind = 'condition' and o.layered not in ('family', 'hypothetical') and lower(o.text) = lower(f.text))",
}


#: Queries that come by other joins to what another one gives.
SAME = {"scopes_by_rows": "scopes", "entity_axes_by_rows": "entity_axes", "entity_sections_by_rows": "entity_sections", "misses_by_table": "mapping_misses", "gold_errors_by_tables": "gold_errors", "coded_by_table": "coded_entities"}
FINAL |= {name: FINAL[other] for name, other in SAME.items()}


def oracle_sql(table: str = "customer", key: str = "c_custkey", patient: str = "c_custkey") -> dict[str, str]:
    """A statement per query of plans.queries over the synthetic notes of a table."""
    chain = _chain(table, key, patient)
    head = "with " + ",\n".join(f"{name} as materialized ({sql})" for name, sql in chain)
    return {name: f"{head}\n{sql}" for name, sql in FINAL.items()}
