"""What the engine does with particular constructions, documents and resources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions import context, text
from clinispan.operators import extract, fhir, learned, evaluate, reconcile
from clinispan.plans import reports
from clinispan.sources import notes

TEXTS = {
    "chain": "No fever, denies chest pain, history of MI, mother had breast cancer.",
    "list": "No fever, chills, or cough.",
    "adjacent": "No family history of breast cancer.",
    "header": "PMH: Denies asthma.",
    "pseudo": "No increase in dyspnea.",
    "doubt": "Pneumonia cannot be ruled out.",
    "ended": "No fever but has cough.",
    "trailing": "Asthma since childhood.",
    "prn": "Albuterol prn for cough.",
    "specific": "Type 2 diabetes and diabetes.",
    "resolved": "Pneumonia resolved.",
    "second": "PMH: asthma.\nAlso carries a diagnosis of GERD.",
    "middle": "The family history of: stroke is unknown. See FAMILY HISTORY: none.",
    "unknown": "SOMETHING: fever.",
    "conflict": "HPI: denies chest pain.\nASSESSMENT AND PLAN: chest pain.",
    "relative": "FH: mother had stroke.\nHPI: stroke.",
    "unmapped": "Lung cancer.",
    "turkish": "İ No asthma. Fever.",
    "dose": "Metformin 500 mg, lisinopril 10 mg daily.",
    "allergy": "Allergic to penicillin; aspirin ok.",
    "plain": "Penicillin given.",
    "nothing": None,
}


@pytest.fixture(scope="module")
def by(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "note_id string, text string")
    return {r["note_id"]: r for r in reconcile.with_decisions(extract.extract_documents(df)).collect()}


def labels(row):
    return [e["assertion"] for e in row["entities"]]


def test_axes(by):
    assert labels(by["chain"]) == ["absent", "absent", "historical", "family"]
    assert labels(by["list"]) == ["absent", "absent"]
    (e,) = by["adjacent"]["entities"]
    assert (e["presence"], e["experiencer"], e["temporality"], e["assertion"]) == ("absent", "family", "historical", "family")
    (e,) = by["header"]["entities"]
    assert (e["presence"], e["temporality"], e["assertion"]) == ("absent", "historical", "absent")
    assert labels(by["pseudo"]) == ["present"] and labels(by["doubt"]) == ["possible"] and labels(by["ended"]) == ["absent", "present"]
    assert labels(by["trailing"]) == ["historical"] and labels(by["resolved"]) == ["present"]
    assert by["prn"]["entities"][0]["assertion"] == "hypothetical"


def test_terms(by):
    assert [e["concept"] for e in by["specific"]["entities"]] == ["t2dm", "diabetes_unspec"]
    assert by["unmapped"]["entities"][0]["code"] is None and by["unmapped"]["entities"][0]["text"] == "Lung cancer"
    assert [(e["concept"], e["start"]) for e in by["turkish"]["entities"]] == [("asthma", 6), ("fever", 13)]
    first, second = by["dose"]["entities"]
    assert (first["attrs"]["dose"], second["attrs"]["dose"], second["attrs"]["frequency"]) == ("500 mg", "10 mg", "daily")
    assert [e["kind"] for e in by["allergy"]["entities"]] == ["allergy", "medication"] and by["plain"]["entities"] == []
    assert by["nothing"]["entities"] == [] and by["nothing"]["n_concepts"] == 0


def test_sections(by):
    assert labels(by["second"]) == ["historical", "historical"]
    (change,) = by["second"]["section_changes"]
    assert (change["concept"], change["from"], change["to"], change["section"]) == ("gerd", "present", "historical", "past_medical_history")
    assert [s["section"] for s in by["middle"]["sections"]] == ["preamble"] and [s["section"] for s in by["unknown"]["sections"]] == ["preamble"]


def test_decisions(by):
    (d,) = by["conflict"]["decisions"]
    assert (d["confidence"], d["presence"], d["conflict"], d["basis"]) == ("unresolved", None, True, reconcile.BASIS_OPEN)
    assert [tuple(x) for x in d["disagreement"]] == [("assessment_and_plan", "present"), ("history_of_present_illness", "absent")]
    assert [(d["experiencer"], d["conflict"]) for d in by["relative"]["decisions"]] == [("family", False), ("patient", False)]


def test_no_denied_finding_collapses_to_present(spark):
    rows = [(p, x, t) for p in ("present", "absent", "possible") for x in ("patient", "family") for t in ("current", "historical", "hypothetical")]
    df = spark.createDataFrame(rows, "p string, x string, t string").withColumn("a", context.collapse(F.col("p"), F.col("x"), F.col("t")))
    assert all((r["a"] == "present") == (r["p"] == "present" and r["x"] == "patient" and r["t"] == "current") for r in df.collect())


def test_resources_are_clean(spark):
    docs = extract.extract_documents(notes.corpus(spark, 60)).cache()
    found = fhir.resources(docs).cache()
    assert fhir.lint(found).count() == 0
    both = spark.createDataFrame([("a", "Mother had stroke. No family history of GERD."), ("b", TEXTS["relative"])], "note_id string, text string")
    assert [tuple(r) for r in fhir.family_leaks(extract.extract_documents(both), patient=None).collect()] == [("b", "stroke")]
    bundle = json.loads(fhir.bundles(docs).first()["json"])
    assert bundle["resourceType"] == "Bundle" and all(e["resource"]["resourceType"] for e in bundle["entry"])
    bad = [("n", "a", '{"id":"a"}'), ("n", "b", '{"resourceType":"Condition","code":{},"verificationStatus":{"coding":[{"code":"refuted"}]},"clinicalStatus":{}}'), ("n", "c", '{"resourceType":"MedicationStatement","status":"odd"}'), ("n", "d", '{"resourceType":"FamilyMemberHistory","status":"completed"}')]
    problems = [r["problem"] for r in fhir.lint(spark.createDataFrame(bad, "note_id string, id string, json string")).collect()]
    assert len(problems) == 7 and any("has a clinicalStatus" in p for p in problems)


def test_learned_classifier(spark):
    model = learned.train(notes.labelled_corpus(spark.range(1500), "id", 5))
    test = evaluate.rule_predictions(notes.labelled_corpus(spark.range(400), "id", 99))
    row = learned.compare(learned.predict(model, test)).first()
    assert row["learned_accuracy"] > 0.85 and row["n"] == 400
    spans = notes.labelled_corpus(spark.range(200), "id").where("substring(text, start + 1, end - start) <> lower(substring(text, start + 1, end - start))")
    assert spans.count() == 0


#: score() for DuckDB, over the rows and the tables of exported().
SCORES = r"""
with sides as (select id, 'left' as side, lower(substr(text, greatest(start - 60, 0) + 1, least(start, 60))) as t from rows union all select id, 'right', lower(substr(text, "end" + 1, 40)) from rows),
words as (select id, side, regexp_extract_all(t, '\w\w+') as w from sides),
grams as (select id, side, gram, count(*) as n from (select id, side, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))) as gram from words) group by all),
known as (select id, side, gram, (1 + ln(n)) * idf as v from grams join features using (side, gram)),
length as (select id, side, sqrt(sum(v * v)) as length from known group by all),
parts as (select id, label, sum(v * weight / length) as parts from known join length using (id, side) join weights using (side, gram) group by all)
select id, label, intercept + coalesce(parts, 0) as score from (select id from rows) cross join intercepts left join parts using (id, label)
"""


def test_learned_classifier_as_tables(spark, tmp_path):
    """Joins and sums of the exported tables give the fitted model's predictions, and DuckDB gives their scores."""
    import duckdb

    model = learned.train(notes.labelled_corpus(spark.range(600), "id", 5))
    seen = notes.labelled_corpus(spark.range(300), "id", 99).union(spark.createDataFrame([(1000, "gout", 0, 4, "gout", "present"), (1001, "No no no gout", 9, 13, "gout", "absent")], "id long, text string, start int, end int, concept string, assertion string"))
    tables = learned.exported(spark, model)
    for name, df in zip(("features", "weights", "intercepts"), tables, strict=True):
        df.write.parquet(str(tmp_path / name))
    seen.write.parquet(str(tmp_path / "rows"))
    kept = [spark.read.parquet(str(tmp_path / name)) for name in ("features", "weights", "intercepts")]
    rows = spark.read.parquet(str(tmp_path / "rows"))
    want = {r["id"]: r["learned"] for r in learned.predict(model, rows).collect()}
    assert {r["id"]: r["learned"] for r in learned.predict_by_tables(rows, *kept).collect()} == want and len(set(want.values())) > 3
    con = duckdb.connect()
    for name in ("features", "weights", "intercepts", "rows"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    theirs = {(i, label): v for i, label, v in con.execute(SCORES).fetchall()}
    ours = {(r["id"], r["label"]): r["score"] for r in learned.score(rows, *kept).collect()}
    assert ours.keys() == theirs.keys() and all(abs(ours[k] - theirs[k]) < 1e-9 for k in ours)


def test_reports(spark, tmp_path):
    made = reports.evaluation(notes.gold(spark, [("No asthma.", [("asthma", "condition", "absent")]), ("Fever.", [("fever", "condition", "absent")])]))
    made = {k: made[k] for k in ("score", "leakage", "mapping")}
    reports.write(made, str(tmp_path))
    shown = reports.markdown(spark, made, str(tmp_path))
    assert "## score" in shown and "| 2 | 1 |" in shown


def plain_terms(low, entries):
    """Dictionary matches as the docstring has them: longer phrases first, each left to right, none over one that is taken."""
    edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
    taken = []
    for phrase, concept in sorted(entries, key=lambda x: -len(x[0])):
        at = 0
        while (at := low.find(phrase, at)) >= 0:
            end = at + len(phrase)
            if (at == 0 or low[at - 1] not in edge) and (end == len(low) or low[end] not in edge):
                if all(end <= s or e <= at for s, e, _ in taken):
                    taken.append((at, end, concept))
                at = end
            else:
                at += 1
    return sorted(taken)


def test_terms_that_overlap_and_touch(spark):
    """Chains of overlapping phrases, double spaces, digits, and letters that are not ASCII."""
    rng = random.Random(4)
    entries = lexicon.pairs(lexicon.CONDITION_TERMS)
    parts = [p for p, _ in entries] + ["type 2", "mellitus", "diabetes mellitus", "acquired", "community", "é", "x", "2", ",", "-", "heart"]
    texts = ["".join(rng.choice(parts) + rng.choice((" ", "  ", "", "-", ", ")) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, low string")
    got = df.select("i", text.terms(F.col("low"), text.dictionary(entries)).alias("t")).collect()
    assert all([tuple(x) for x in r["t"]] == plain_terms(texts[r["i"]], entries) for r in got)
    assert sum(len(r["t"]) for r in got) > 500


def test_sentences_at_odd_places(spark):
    """Repeated spaces, abbreviations, letters that are not ASCII and sentences that repeat have the offsets of their own place."""
    odd = "Seen by Dr. Lee.  Fever.   Fever.\n\n\tÉlan vital!\u00a0 q.d. dosing; no. more"
    (row,) = spark.createDataFrame([(odd,)], "t string").select(text.sentences(F.col("t")).alias("s")).collect()
    assert [s["text"].strip() for s in row["s"]] == ["Seen by Dr. Lee.", "Fever.", "Fever.", "Élan vital!", "q.d. dosing;", "no.", "more"]
    assert all(odd[s["start"] : s["end"]] == s["text"] for s in row["s"])
    starts = [s["start"] for s in row["s"]]
    assert starts == sorted(set(starts))


def test_tables_of_ones_own(spark):
    df = spark.createDataFrame([("n", "PLAN: no gout.\nODD: gout.")], "note_id string, text string")
    own = {"condition": {"gout": ("gout",)}, "medication": {}, "allergy": {}}
    docs = extract.with_sections(extract.with_entities(df, dictionaries=own, terminologies={"condition": ("OWN", {"gout": ("1", "Gout")})}), defaults={"assessment_and_plan": "historical"})
    row = reconcile.with_decisions(docs, authority={"assessment_and_plan": 5}).first()
    assert [(e["concept"], e["assertion"], e["code"]) for e in row["entities"]] == [("gout", "absent", "1"), ("gout", "historical", "1")]
    assert row["policy"] == reconcile.POLICY and row["n_conflicts"] == 1


def test_literal_tables_hold_any_text(spark):
    """Quotes, escapes, variables, control characters and comments come back as they are."""
    values = ["it's", "a\\b", "\\'", "${x}", "$", "a\0b", "line\nbreak", "%_\\%", "é\U0001f600", "", "\\u0041", '"q"', "--c", "/*", None]
    numbered = {v: i for i, v in enumerate(values[:-1])}
    got = spark.range(1).select(text.array_of(values).alias("a"), text.map_of(numbered).alias("m"), text.table_of([(v, 1) for v in values], ("p", "n")).alias("t"), text.map_of({}).alias("e")).first()
    assert got["a"] == values and got["m"] == numbered and [(r["p"], r["n"]) for r in got["t"]] == [(v, 1) for v in values] and got["e"] == {}
