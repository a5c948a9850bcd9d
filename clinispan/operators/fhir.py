"""Entities as FHIR-shaped resources, a record of everything left out, bundles, and a lint of the shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan.functions.text import map_of

# Code systems, and the statuses that assertions become.
SYSTEMS = {"SNOMED-CT": "http://snomed.info/sct", "RxNorm": "http://www.nlm.nih.gov/research/umls/rxnorm"}
CONDITION_CLINICAL = "http://terminology.hl7.org/CodeSystem/condition-clinical"
CONDITION_VERIFICATION = "http://terminology.hl7.org/CodeSystem/condition-ver-status"
ALLERGY_CLINICAL = "http://terminology.hl7.org/CodeSystem/allergyintolerance-clinical"
ALLERGY_VERIFICATION = "http://terminology.hl7.org/CodeSystem/allergyintolerance-verification"
CLINICAL_STATUS = {"present": "active", "historical": "resolved", "possible": "active"}
VERIFICATION_STATUS = {"present": "confirmed", "historical": "confirmed", "possible": "provisional", "absent": "refuted"}
MEDICATION_STATUS = {"present": "active", "historical": "completed", "absent": "not-taken", "possible": "unknown", "hypothetical": "active", "family": "unknown"}
VERIFICATIONS = ("unconfirmed", "provisional", "differential", "confirmed", "refuted", "entered-in-error")
MEDICATION_STATUSES = ("active", "completed", "entered-in-error", "intended", "stopped", "on-hold", "not-taken", "unknown")
FAMILY_STATUSES = ("partial", "completed", "entered-in-error", "health-unknown")
RELATIONSHIP = "unspecified family member"
DROPPED_REASON = "conditional instruction, not a finding; emitting it would put a condition the patient does not have on the problem list"


def _concept(e: Column) -> Column:
    """A CodeableConcept: the words of the text always, a coding if the concept has a code."""
    system = F.try_element_at(map_of(SYSTEMS), e["code_system"])
    coding = F.struct(system.alias("system"), e["code"].alias("code"), e["code_display"].alias("display"))
    return F.struct(e["text"].alias("text"), F.when(e["code"].isNotNull(), F.array(coding)).alias("coding"))


def _status(system: str, code: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"))).alias("coding")))


def _reference(prefix: str, value: Column) -> Column:
    return F.struct(F.concat(F.lit(prefix), value.cast("string")).alias("reference"))


def numbered(docs: DataFrame, note: str = "note_id", patient: str | None = "patient_id") -> DataFrame:
    """A row per entity e of docs: note_id, patient_id ('example' without one), n (from 1, over all entities of the note) and its resource id."""
    who = F.col(patient).cast("string") if patient else F.lit("example")
    out = docs.select(F.col(note).cast("string").alias("note_id"), who.alias("patient_id"), F.posexplode_outer("entities").alias("n", "e")).where("e is not null")
    return out.withColumn("n", F.col("n") + 1).withColumn("id", F.concat_ws("-", "note_id", "n"))


def _condition(e: Column, id_: Column) -> list[Column]:
    clinical = F.try_element_at(map_of(CLINICAL_STATUS), e["assertion"])
    verification = F.try_element_at(map_of(VERIFICATION_STATUS), e["assertion"])
    source = F.array(_reference("DocumentReference/", F.col("note_id")))
    return [F.lit("Condition").alias("resourceType"), id_.alias("id"), _reference("Patient/", F.col("patient_id")).alias("subject"), _concept(e).alias("code"), _status(CONDITION_VERIFICATION, verification).alias("verificationStatus"), F.array(F.struct(source.alias("detail"))).alias("evidence"), _status(CONDITION_CLINICAL, clinical).alias("clinicalStatus")]


def _medication(e: Column, id_: Column) -> list[Column]:
    a = e["attrs"]
    needed = (e["assertion"] == "hypothetical") | F.coalesce(a["frequency"].isin("prn", "as needed"), F.lit(False))
    quantity = F.struct(F.split_part(a["dose"], F.lit(" "), F.lit(1)).cast("double").alias("value"), F.split_part(a["dose"], F.lit(" "), F.lit(2)).alias("unit"))
    rate = F.when(a["dose"].isNotNull(), F.array(F.struct(quantity.alias("doseQuantity"))))
    dosage = F.struct(rate.alias("doseAndRate"), F.when(a["route"].isNotNull(), F.struct(a["route"].alias("text"))).alias("route"), a["frequency"].alias("text"), F.when(needed, F.lit(True)).alias("asNeededBoolean"))
    some = a["dose"].isNotNull() | a["route"].isNotNull() | a["frequency"].isNotNull() | needed
    status = F.try_element_at(map_of(MEDICATION_STATUS), e["assertion"])
    return [F.lit("MedicationStatement").alias("resourceType"), id_.alias("id"), _reference("Patient/", F.col("patient_id")).alias("subject"), status.alias("status"), _concept(e).alias("medicationCodeableConcept"), F.array(_reference("DocumentReference/", F.col("note_id"))).alias("derivedFrom"), F.when(some, F.array(dosage)).alias("dosage")]


def _allergy(e: Column, id_: Column) -> list[Column]:
    return [F.lit("AllergyIntolerance").alias("resourceType"), id_.alias("id"), _reference("Patient/", F.col("patient_id")).alias("patient"), _status(ALLERGY_CLINICAL, F.lit("active")).alias("clinicalStatus"), _status(ALLERGY_VERIFICATION, F.lit("confirmed")).alias("verificationStatus"), _concept(e).alias("code")]


def _family(relatives: Column) -> list[Column]:
    return [F.lit("FamilyMemberHistory").alias("resourceType"), F.concat("note_id", F.lit("-fmh")).alias("id"), F.lit("completed").alias("status"), _reference("Patient/", F.col("patient_id")).alias("patient"), F.struct(F.lit(RELATIONSHIP).alias("text")).alias("relationship"), F.transform(relatives, lambda e: F.struct(_concept(e).alias("code"))).alias("condition")]


def _own(e: Column) -> Column:
    """A condition of the patient, and no conditional instruction."""
    return (e["kind"] == "condition") & ~e["assertion"].isin("family", "hypothetical")


def _relatives(entities: str = "entities") -> Column:
    return F.filter(entities, lambda e: (e["kind"] == "condition") & (e["assertion"] == "family"))


def conditions(entities: DataFrame) -> DataFrame:
    """Condition resources of numbered(): of the patient, and no conditional instructions."""
    e = F.col("e")
    return entities.where(_own(e)).select("note_id", "n", *_condition(e, F.col("id")))


def dropped(entities: DataFrame) -> DataFrame:
    """What is left out, and why."""
    e = F.col("e")
    return entities.where((e["kind"] == "condition") & (e["assertion"] == "hypothetical")).select("note_id", e["text"].alias("text"), e["assertion"].alias("assertion"), F.lit(DROPPED_REASON).alias("reason"))


def medications(entities: DataFrame) -> DataFrame:
    """MedicationStatement resources; dosage only where the text gives one."""
    e = F.col("e")
    return entities.where(e["kind"] == "medication").select("note_id", "n", *_medication(e, F.col("id")))


def allergies(entities: DataFrame) -> DataFrame:
    """AllergyIntolerance resources, active and confirmed whatever the assertion, which assertion keeps for those who ask."""
    e = F.col("e")
    return entities.where(e["kind"] == "allergy").select("note_id", "n", *_allergy(e, F.col("id")), e["assertion"].alias("assertion"))


def family_history(docs: DataFrame, note: str = "note_id", patient: str | None = "patient_id") -> DataFrame:
    """A FamilyMemberHistory per note that has conditions of relatives, after its other resources."""
    who = F.col(patient).cast("string") if patient else F.lit("example")
    # Behind a generator the filter stays above the extraction, which would else be made once more for it.
    row = F.array(F.struct((F.size("entities") + 1).alias("n"), _relatives().alias("relatives")))
    out = docs.select(F.col(note).cast("string").alias("note_id"), who.alias("patient_id"), F.inline_outer(row)).where(F.size("relatives") > 0)
    return out.select("note_id", "n", *_family(F.col("relatives")))


def resources(docs: DataFrame, note: str = "note_id", patient: str | None = "patient_id") -> DataFrame:
    """All resources as JSON (nulls left out): note_id, n, type, id, json. One pass: a row per entity, and one for the relatives."""
    who = F.col(patient).cast("string") if patient else F.lit("example")
    e, relatives = F.col("e"), F.col("relatives")
    slots = docs.select(F.col(note).cast("string").alias("note_id"), who.alias("patient_id"), _relatives().alias("relatives"), F.posexplode_outer(F.array_append("entities", F.lit(None))).alias("n", "e"))
    slots = slots.withColumn("n", F.col("n") + 1)
    kind = F.when(e.isNull(), F.when(F.size(relatives) > 0, "FamilyMemberHistory")).when(_own(e), "Condition").when(e["kind"] == "medication", "MedicationStatement").when(e["kind"] == "allergy", "AllergyIntolerance")
    typed = slots.withColumn("type", kind).where("type is not null").withColumn("id", F.when(e.isNull(), F.concat("note_id", F.lit("-fmh"))).otherwise(F.concat_ws("-", "note_id", "n")))
    bodies = {"Condition": _condition(e, F.col("id")), "MedicationStatement": _medication(e, F.col("id")), "AllergyIntolerance": _allergy(e, F.col("id")), "FamilyMemberHistory": _family(relatives)}
    json = F.coalesce(*(F.when(F.col("type") == name, F.to_json(F.struct(*fields))) for name, fields in bodies.items()))
    return typed.select("note_id", "n", "type", "id", json.alias("json"))


def bundles(docs: DataFrame, note: str = "note_id", patient: str | None = "patient_id") -> DataFrame:
    """A collection Bundle per note: note_id, n_resources, json; notes without resources have an empty one. Each comes from its note's row alone: no shuffle, no join."""
    who = F.col(patient).cast("string") if patient else F.lit("example")
    whole = docs.select(F.col(note).cast("string").alias("note_id"), who.alias("patient_id"), "entities", _relatives().alias("relatives"))

    def resource(e: Column, i: Column) -> Column:
        id_ = F.concat_ws("-", "note_id", i + 1)
        kinds = ((_own(e), _condition), (e["kind"] == "medication", _medication), (e["kind"] == "allergy", _allergy))
        return F.coalesce(*(F.when(test, F.to_json(F.struct(*fields(e, id_)))) for test, fields in kinds))

    relatives = F.when(F.size("relatives") > 0, F.to_json(F.struct(*_family(F.col("relatives")))))
    whole = whole.select("note_id", F.array_compact(F.array_append(F.transform("entities", resource), relatives)).alias("all"))
    entries = F.array_join(F.transform("all", lambda r: F.concat(F.lit('{"resource":'), r, F.lit("}"))), ",")
    body = F.expr("substring(to_json(struct(note_id as x)), 6, length(to_json(struct(note_id as x))) - 6)")
    return whole.select("note_id", F.coalesce(F.size("all"), F.lit(0)).alias("n_resources"), F.concat(F.lit('{"resourceType":"Bundle","id":'), body, F.lit(',"type":"collection","entry":['), F.coalesce(entries, F.lit("")), F.lit("]}")).alias("json"))


def lint(found: DataFrame) -> DataFrame:
    """note_id, id and problem for each rule that a resource of found (note_id, id, json) breaks; allergies are not linted."""
    shape = "resourceType string, subject string, code struct<text:string,coding:array<struct<code:string>>>, verificationStatus struct<coding:array<struct<code:string>>>, clinicalStatus string, status string, medicationCodeableConcept string, relationship string"
    r = F.col("r")
    kind, verification = r["resourceType"], F.get(r["verificationStatus"]["coding"], F.lit(0))["code"]
    named = F.coalesce(F.col("id"), F.lit("None"))

    def known(x: Column, values: tuple[str, ...]) -> Column:
        return F.coalesce(x.isin(*values), F.lit(False))

    no_code = (F.coalesce(r["code"]["text"], F.lit("")) == "") & (F.coalesce(F.size(r["code"]["coding"]), F.lit(0)) <= 0)
    rules = F.array(
        F.when(F.coalesce(kind, F.lit("")) == "", F.lit("no resourceType")),
        F.when((kind == "Condition") & r["subject"].isNull(), F.concat(named, F.lit(": a Condition needs a subject"))),
        F.when((kind == "Condition") & no_code, F.concat(named, F.lit(": a Condition needs words or a coding"))),
        F.when((kind == "Condition") & (verification == "refuted") & r["clinicalStatus"].isNotNull(), F.concat(named, F.lit(": refuted, and yet it has a clinicalStatus"))),
        F.when((kind == "Condition") & ~known(verification, VERIFICATIONS), F.concat(named, F.lit(": unknown verificationStatus "), F.coalesce(F.concat(F.lit("'"), verification, F.lit("'")), F.lit("None")))),
        F.when((kind == "MedicationStatement") & ~known(r["status"], MEDICATION_STATUSES), F.concat(named, F.lit(": unknown status of a MedicationStatement "), F.coalesce(F.concat(F.lit("'"), r["status"], F.lit("'")), F.lit("None")))),
        F.when((kind == "MedicationStatement") & r["medicationCodeableConcept"].isNull(), F.concat(named, F.lit(": a MedicationStatement names no medication"))),
        F.when((kind == "FamilyMemberHistory") & ~known(r["status"], FAMILY_STATUSES), F.concat(named, F.lit(": unknown status of a FamilyMemberHistory"))),
        F.when((kind == "FamilyMemberHistory") & r["relationship"].isNull(), F.concat(named, F.lit(": a FamilyMemberHistory needs a relationship"))),
    )
    out = found.select("note_id", "id", F.from_json("json", shape).alias("r")).withColumn("problem", F.explode_outer(F.array_compact(rules))).where("problem is not null")
    return out.select("note_id", "id", "problem")


def patient_conditions(found: DataFrame) -> DataFrame:
    """note_id and lower-cased text of each Condition (refuted ones too) of found (note_id, type, json)."""
    return found.where("type = 'Condition'").select("note_id", F.lower(F.get_json_object("json", "$.code.text")).alias("text"))


def family_leaks(docs: DataFrame, note: str = "note_id", patient: str | None = "patient_id") -> DataFrame:
    """Conditions of relatives that are also a Condition of the patient in the same note: note_id, text."""
    own = F.transform(F.filter("entities", _own), lambda e: F.lower(e["text"]))
    told = F.transform(_relatives(), lambda e: F.lower(e["text"]))
    return docs.select(F.col(note).cast("string").alias("note_id"), told.alias("told"), own.alias("own")).select("note_id", F.explode_outer(F.filter("told", lambda t: F.array_contains("own", t))).alias("text")).where("text is not null")
