"""The evaluation as reports: computed once, written as JSON, and rendered as Markdown from what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan.operators import evaluate, extract, fhir, views
from clinispan.sources import notes


def evaluation(gold: DataFrame) -> dict[str, DataFrame]:
    """Reports by name for gold cases: score, confusion, leakage, errors, mapping, misses, resources, lint, leaks."""
    cases = evaluate.predicted(gold)
    found = evaluate.matches(cases)
    documents = extract.extract_documents(gold, sections=False).withColumnRenamed("case_id", "note_id")
    entities, resources = views.entities(documents), fhir.resources(documents, patient=None)
    return {
        "score": evaluate.score(cases),
        "confusion": evaluate.confusion(found),
        "leakage": evaluate.leakage(found),
        "errors": evaluate.errors(found),
        "mapping": views.mapping_rate(entities),
        "misses": views.mapping_misses(entities),
        "resources": resources.groupBy("type").agg(F.count("*").alias("n")),
        "lint": fhir.lint(resources),
        "leaks": fhir.family_leaks(documents, patient=None),
    }


def section_evaluation(gold: DataFrame) -> dict[str, DataFrame]:
    """Reports for gold documents with sections: summary and one row per document."""
    scores = evaluate.section_scores(gold)
    return {"sections": evaluate.section_summary(scores), "section_cases": scores}


def write(reports: dict[str, DataFrame], out: str) -> None:
    """Each report as JSON under out."""
    for name, df in reports.items():
        notes.write_json(df, f"{out}/{name}")


def markdown(spark: SparkSession, reports: dict[str, DataFrame], out: str) -> str:
    """What write() left under out as Markdown, so that no figure is shown that no run has written."""
    parts = []
    for name, df in reports.items():
        written = spark.read.schema(df.schema).json(f"{out}/{name}")
        parts.append(f"## {name}\n\n{notes.markdown_table(written)}")
    return "\n\n".join(parts) + "\n"
