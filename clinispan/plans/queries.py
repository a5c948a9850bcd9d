"""The engine's queries over synthetic notes: one for each operator, flat and with fixed column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.operators import evaluate, extract, fhir, joins, learned, phrases, reconcile, rows, terminology, views
from clinispan.sources import notes
from clinispan.streaming import service

Query = Callable[[SparkSession, str], DataFrame]


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_entities(notes.customer_notes(spark, sf_dir))


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_documents(notes.customer_notes(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(_plain(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.with_decisions(_layered(spark, sf_dir))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.numbered(_layered(spark, sf_dir))


def entity_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every finding with its three axes."""
    return _entities(spark, sf_dir).select("note_id", "sent_id", "start", "end", "text", "kind", "concept", "presence", "experiencer", "temporality", "assertion", "assertion_source")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sentences(notes.customer_notes(spark, sf_dir)).select("note_id", "sent_id", F.lower("text").alias("low"))


def _row_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, triggers, _ = rows.package_tables(spark)
    return rows.entities(views.sentences(notes.customer_notes(spark, sf_dir)), table, triggers)


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary matches by the inverted index."""
    return rows.hits(_texts(spark, sf_dir), rows.package_tables(spark)[0]).select("note_id", "sent_id", "kind", "s", "e", "concept")


#: A phrase for each order: a finding, and what may follow it in a note, or the order's number.
GENERATED = notes.Pick([p for p, _ in lexicon.pairs(lexicon.CONDITION_TERMS)], 1, 7)


def generated_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    after = F.when(k % 10 == 0, "today").when(k % 10 == 1, "and").otherwise(k.cast("string"))
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat_ws(" ", GENERATED.spark(k), after).alias("phrase"), k.alias("k"))
    return made.groupBy("phrase").agg(F.min("k").alias("ord")).select(F.lit("generated").alias("kind"), "phrase", F.col("ord").cast("string").alias("concept"), "ord")


def phrase_hits_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matches of a lexicon that grows with the orders."""
    found = phrases.find_phrases(_texts(spark, sf_dir), generated_lexicon(spark, sf_dir))
    return phrases.longest_matches(found, ["note_id", "sent_id"]).select("note_id", "sent_id", "s", "e", "phrase", "concept")


def scopes_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of sentences that have a match, as running extremes of a stream of places."""
    texts = _texts(spark, sf_dir)
    table, triggers, _ = rows.package_tables(spark)
    asked = texts.join(joins.shuffled(rows.hits(texts, table).select("note_id", "sent_id").distinct()), ["note_id", "sent_id"], "left_semi")
    return rows.scopes(asked, triggers)


def entity_axes_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_entities(spark, sf_dir).drop("dose", "route", "frequency")


def entity_sections_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings placed in sections by a join of intervals."""
    found = _row_entities(spark, sf_dir).select("note_id", "start", "kind", "concept")
    return rows.with_sections(found, views.section_spans(extract.with_sections(_plain(spark, sf_dir))))


def coded_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = terminology.coded(_entities(spark, sf_dir), terminology.as_of(rows.package_tables(spark)[2]))
    return coded.select("note_id", "start", "kind", "concept", *terminology.CODE)


def misses_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminology.misses(_entities(spark, sf_dir), terminology.as_of(rows.package_tables(spark)[2]))


def fhir_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get("code.coding", F.lit(0))["code"]
    return fhir.conditions(_resources(spark, sf_dir)).select("id", F.col("subject.reference").alias("subject"), F.col("code.text").alias("text"), code.alias("code"), F.get("clinicalStatus.coding", F.lit(0))["code"].alias("clinical_status"), F.get("verificationStatus.coding", F.lit(0))["code"].alias("verification_status"))


def fhir_medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fhir.medications(_resources(spark, sf_dir)).withColumn("d", F.get("dosage", F.lit(0)))
    quantity = F.get("d.doseAndRate", F.lit(0))["doseQuantity"]
    return m.select("id", F.col("medicationCodeableConcept.text").alias("text"), F.get("medicationCodeableConcept.coding", F.lit(0))["code"].alias("code"), "status", quantity["value"].alias("dose_value"), quantity["unit"].alias("dose_unit"), F.col("d.route.text").alias("route"), F.col("d.text").alias("frequency"), F.col("d.asNeededBoolean").alias("as_needed"))


def fhir_allergies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.allergies(_resources(spark, sf_dir)).select("id", F.col("patient.reference").alias("patient"), F.col("code.text").alias("text"), F.get("clinicalStatus.coding", F.lit(0))["code"].alias("clinical_status"), F.get("verificationStatus.coding", F.lit(0))["code"].alias("verification_status"), "assertion")


def fhir_bundle_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the Bundles' JSON, entry by entry, read back from it."""
    named = "struct<text:string,coding:array<struct<code:string>>>"
    shape = f"id string, type string, entry array<struct<resource:struct<resourceType:string,id:string,subject:struct<reference:string>,patient:struct<reference:string>,code:{named},medicationCodeableConcept:{named},condition:array<struct<code:{named}>>>>>"
    read = fhir.bundles(_layered(spark, sf_dir)).select(F.from_json("json", shape).alias("b")).select("b.id", "b.type", F.posexplode_outer("b.entry").alias("ord", "e")).where("e is not null")
    r = F.col("e.resource")
    concept = F.coalesce(r["code"], r["medicationCodeableConcept"])
    return read.select(F.col("id").alias("bundle_id"), F.col("type").alias("bundle_type"), "ord", r["resourceType"].alias("resource_type"), r["id"].alias("id"), F.coalesce(r["subject"]["reference"], r["patient"]["reference"]).alias("subject"), concept["text"].alias("text"), F.get(concept["coding"], F.lit(0))["code"].alias("code"), F.coalesce(F.size(r["condition"]), F.lit(0)).alias("n_conditions"))


def patient_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.patient_conditions(fhir.resources(_layered(spark, sf_dir)))


def fhir_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.family_history(_layered(spark, sf_dir)).select("id", F.size("condition").cast("long").alias("n_conditions"), F.get("condition", F.lit(0))["code"]["text"].alias("first_text"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per note: single ones and batches of two, some of them bad, by the note's id."""
    n = notes.customer_notes(spark, sf_dir)
    single = F.to_json(F.struct("text"))
    batch = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("id"), F.col("text")), F.struct(F.lit(None).cast("string").alias("id"), F.lit(" ").alias("text"))).alias("documents")))
    kind = F.pmod("note_id", F.lit(5))
    route = F.when(kind == 1, "/extract/batch").when(kind == 2, "/elsewhere").otherwise("/extract")
    body = F.when(kind == 1, batch).when(kind == 3, "{broken").otherwise(single)
    return n.select(F.col("note_id").cast("string").alias("request_id"), route.alias("route"), F.lit(None).cast("string").alias("token"), body.alias("body"))


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.validated(_requests(spark, sf_dir)).groupBy("route", "status", "error_class").agg(F.count("*").alias("n"))


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.results(service.validated(_requests(spark, sf_dir))).select("request_id", "ord", "id", "ok", "error", "n_entities")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.batch_summary(service.results(service.validated(_requests(spark, sf_dir))))


def safe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = service.validated(_requests(spark, sf_dir))
    return service.safe_log(checked, service.results(checked)).drop("n_bytes")


def _self_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes as cases, with the section layer's results as expected triples and the sentence layer's as predicted ones."""
    expected = F.transform("entities", lambda e: F.struct(e["concept"].alias("concept"), e["kind"].alias("kind"), e["assertion"].alias("assertion")))
    plain = F.transform("entities", lambda e: e.withField("assertion", F.when(e["section_default"].isNotNull(), F.lit("present")).otherwise(e["assertion"])))
    return _layered(spark, sf_dir).select(F.col("note_id").alias("case_id"), expected.alias("expected"), plain.alias("entities"))


def gold_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score(_self_gold(spark, sf_dir))


def gold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(evaluate.matches(_self_gold(spark, sf_dir)))


def gold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(evaluate.matches(_self_gold(spark, sf_dir)))


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The expected and the predicted triples of _self_gold() as two tables."""
    gold = _self_gold(spark, sf_dir)
    return [gold.select("case_id", F.posexplode_outer(side).alias("ord", "x")).where("x is not null").select("case_id", "ord", "x.concept", "x.kind", "x.assertion") for side in ("expected", "entities")]


def gold_errors_by_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(evaluate.match_tables(*_sides(spark, sf_dir)))


def gold_confusion_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix as rows, with its sums, in one pass."""
    return evaluate.confusion_margins(evaluate.matches(_self_gold(spark, sf_dir)))


def gold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied and family findings that come out as present, here those that sections made so of what sentences left as present."""
    return evaluate.leakage(evaluate.match_tables(*_sides(spark, sf_dir)))


def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates over the notes: expected is what the sections give, but in every third note what the sentences give; every fifth is arguable."""

    def pairs(assertion: Callable[[Column], Column]) -> Column:
        own = F.filter("entities", lambda e: e["kind"] == "condition")
        return F.transform(own, lambda e: F.struct(e["concept"].alias("concept"), F.lit("condition").alias("kind"), assertion(e).alias("assertion")))

    layered = _layered(spark, sf_dir)
    plain = pairs(lambda e: F.when(e["section_default"].isNotNull(), F.lit("present")).otherwise(e["assertion"]))
    expected = F.when(F.col("note_id") % 3 == 0, plain).otherwise(pairs(lambda e: e["assertion"]))
    gold = layered.select(F.col("note_id").alias("case_id"), expected.alias("expected"), (F.col("note_id") % 5 == 0).alias("arguable"), "entities", "section_changes")
    return evaluate.section_summary(evaluate.section_scores(gold))


def service_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, failures and entities of all requests, observed while the responses are written."""
    done = service.results(service.validated(_requests(spark, sf_dir)))
    return spark.createDataFrame([service.observed_totals(done, lambda df: df.write.format("noop").mode("overwrite").save())], service.TOTALS)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in sentences that neither classifier has seen, one per supplier and part, with the learned and the rules' assertion. The learner trains on one per customer."""

    def ids(table: str, key: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)

    model = learned.train(notes.labelled_corpus(ids("customer", "c_custkey"), "c_custkey", 5))
    seen = ids("supplier", "s_suppkey").select((-F.col("s_suppkey")).alias("id")).union(ids("part", "p_partkey"))
    return learned.predict(model, evaluate.rule_predictions(notes.labelled_corpus(seen, "id", 99)))


def learned_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.compare(_compared(spark, sf_dir))


def learned_bake_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bake_off(_compared(spark, sf_dir))


def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the sentence layer by class, with the sections' results of the notes as truth."""
    each = _layered(spark, sf_dir).select(F.explode_outer("entities").alias("e")).where("e is not null")
    both = each.select(F.col("e.assertion").alias("truth"), F.when(F.col("e.section_default").isNotNull(), "present").otherwise(F.col("e.assertion")).alias("got"))
    scores = evaluate.report(evaluate.per_class(both))
    return scores.select("label", "support", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def fhir_lint_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the lint reports which problem in the notes' resources, each broken in one of six ways, or in none, by its number."""
    made = fhir.resources(_layered(spark, sf_dir))
    edits = {
        1: F.regexp_replace("json", '"resourceType":"[A-Za-z]+",', ""),
        2: F.regexp_replace("json", '"subject":[{][^}]*[}],', ""),
        3: F.regexp_replace("json", '"code":"(confirmed|refuted|provisional)"', '"code":"sure"'),
        4: F.regexp_replace("json", '"status":"[a-z-]+"', '"status":"odd"'),
        5: F.regexp_replace("json", '"relationship":[{][^}]*[}],', ""),
        6: F.regexp_replace("json", '"medicationCodeableConcept"', '"medication"'),
    }
    broken = F.col("json")
    for k, edit in edits.items():
        broken = F.when(F.pmod("n", F.lit(7)) == k, edit).otherwise(broken)
    return fhir.lint(made.withColumn("json", broken)).groupBy(F.regexp_replace("problem", "^[^:]*: ", "").alias("problem")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    entity = {
        "condition_entities": (("note_id", "start", "end", "text", "concept"), "kind = 'condition'"),
        "negated_entities": (("note_id", "start", "text", "kind", "concept", "experiencer", "temporality"), "presence = 'absent'"),
        "med_attrs": (("note_id", "start", "concept", "dose", "route", "frequency"), "kind = 'medication'"),
        "allergies": (("note_id", "start", "text", "concept", "assertion"), "kind = 'allergy'"),
        "coded_entities": (("note_id", "start", "kind", "concept", "code_system", "code", "code_display"), "true"),
    }
    layered = {
        "entity_sections": ("note_id", "start", "kind", "concept", "section"),
        "section_defaults": ("note_id", "start", "kind", "concept", "assertion", "section_default"),
    }
    decided = ("note_id", "concept", "experiencer", "presence", "temporality", "n_mentions", "conflict", "confidence", "basis")
    out: dict[str, Query] = {
        "synth_notes": notes.customer_notes,
        "sentences": lambda s, d: views.sentences(notes.customer_notes(s, d)),
        "trigger_hits": lambda s, d: views.trigger_hits(notes.customer_notes(s, d)),
        "scopes": lambda s, d: views.scopes(notes.customer_notes(s, d)).where("start < end"),
        "entity_axes": entity_axes,
        "assertion_counts": lambda s, d: _entities(s, d).groupBy("kind", "assertion").agg(F.count("*").alias("n")),
        "mapping_hit_rate": lambda s, d: views.mapping_rate(_entities(s, d)),
        "mapping_misses": lambda s, d: views.mapping_misses(_entities(s, d)),
        "section_spans": lambda s, d: views.section_spans(_layered(s, d)),
        "section_audit": lambda s, d: views.section_audit(_layered(s, d)),
        "reconcile_decisions": lambda s, d: reconcile.decisions(_decided(s, d)).select(*decided),
        "reconcile_rows": lambda s, d: reconcile.rows(_decided(s, d)),
        "reconcile_all_rows": lambda s, d: reconcile.rows(_decided(s, d), include_unresolved=True),
        "reconcile_counts": lambda s, d: _decided(s, d).select("note_id", F.inline_outer(F.array(F.struct(*(F.col(c).cast("long").alias(c) for c in ("n_concepts", "n_conflicts", "n_unresolved")))))).where("n_concepts > 0"),
        "reconcile_disagreements": lambda s, d: reconcile.decisions(_decided(s, d)).select("note_id", "concept", "experiencer", F.explode_outer("disagreement").alias("x")).where("x is not null").select("note_id", "concept", "experiencer", "x.section", "x.presence"),
        "fhir_conditions": fhir_conditions,
        "fhir_medications": fhir_medications,
        "fhir_allergies": fhir_allergies,
        "fhir_family": fhir_family,
        "fhir_dropped": lambda s, d: fhir.dropped(_resources(s, d)),
        "fhir_type_counts": lambda s, d: fhir.resources(_layered(s, d)).groupBy("type").agg(F.count("*").alias("n")),
        "fhir_bundle_sizes": lambda s, d: fhir.bundles(_layered(s, d)).select("note_id", "n_resources"),
        "fhir_lint": lambda s, d: fhir.lint(fhir.resources(_layered(s, d))).agg(F.count("*").cast("int").alias("n_problems")),
        "family_leak": lambda s, d: fhir.family_leaks(_layered(s, d)).agg(F.count("*").alias("n_leaks")),
        "request_status": request_status,
        "batch_results": batch_results,
        "batch_summary": batch_summary,
        "safe_log": safe_log,
        "gold_prf": gold_prf,
        "gold_confusion": gold_confusion,
        "gold_errors": gold_errors,
        "learned_comparison": learned_comparison,
        "learned_bake_off": learned_bake_off,
        "rule_classes": rule_classes,
        "phrase_hits": phrase_hits,
        "phrase_hits_generated": phrase_hits_generated,
        "scopes_by_rows": scopes_by_rows,
        "entity_axes_by_rows": entity_axes_by_rows,
        "entity_sections_by_rows": entity_sections_by_rows,
        "coded_by_table": coded_by_table,
        "misses_by_table": misses_by_table,
        "gold_errors_by_tables": gold_errors_by_tables,
        "gold_confusion_margins": gold_confusion_margins,
        "section_summary": section_summary,
        "gold_leakage": gold_leakage,
        "fhir_bundle_entries": fhir_bundle_entries,
        "patient_conditions": patient_conditions,
        "service_totals": service_totals,
        "fhir_lint_broken": fhir_lint_broken,
    }
    for name, (columns, test) in entity.items():
        out[name] = lambda s, d, c=columns, t=test: _entities(s, d).where(t).select(*c)
    for name, columns in layered.items():
        out[name] = lambda s, d, c=columns: views.entities(_layered(s, d)).select(*c)
    return out
