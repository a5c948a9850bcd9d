"""Requests to responses, as one projection over a table or a stream of requests, with a log that cannot hold text.

A request row: request_id, route ('/extract' or '/extract/batch'), token, body (JSON). A bad request gets a status and a class of
error, never a message that could quote it; a bad document does not fail its batch.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from clinispan.functions.text import is_blank
from clinispan.operators import extract, fhir, reconcile

REQUEST = "request_id string, route string, token string, body string"
MAX_BYTES = 200_000
ROUTES = ("/extract", "/extract/batch")
LOG_FIELDS = ("request_id", "route", "status", "n_bytes", "n_documents", "n_entities", "error_class")
DISCLAIMER = "For demonstration with invented notes only. The rules miss some negations and misread others: a finding marked absent is a hint to read the note, not evidence of health. Use presence, experiencer and temporality; the one-word assertion leaves part of them out."


def about() -> dict:
    """What the service is: its disclaimer, the values of the axes, and what is logged."""
    axes = {"presence": ["present", "absent", "possible"], "experiencer": ["patient", "family"], "temporality": ["current", "historical", "hypothetical"]}
    return {"disclaimer": DISCLAIMER, "assertion_axes": axes, "logging": {"request_text_logged": False, "fields": list(LOG_FIELDS)}, "routes": list(ROUTES)}


def health(log: DataFrame) -> DataFrame:
    return log.agg(F.lit("ok").alias("status"), F.count("*").alias("logged_requests"))




def _text(v: Column) -> Column:
    """A variant's string; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _digest(salt: str, token: Column) -> Column:
    """What a token is compared by, so that plans and logs, which show literals, never show the token itself."""
    return F.sha2(F.concat(F.lit(salt), token), 256)


def validated(requests: DataFrame, token: str | None = None) -> DataFrame:
    """requests with status, error_class and documents: array<struct<ord, id, text>> of those with status 200 (text null for a bad document).

    In order: 401 without the token that the service was given; 404 for another route; 413 for a body over MAX_BYTES; 400 for
    a body that is no JSON object, or has no text, or no documents.
    """
    body = F.try_parse_json("body")
    salt = secrets.token_hex(16)
    digest = hashlib.sha256(f"{salt}Bearer {token}".encode()).hexdigest()
    single, batch = F.col("route") == ROUTES[0], F.col("route") == ROUTES[1]
    out = requests.withColumns({"n_bytes": F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"), "__v": body})
    out = out.withColumn("__kind", F.schema_of_variant("__v"))
    out = out.withColumns({"__text": _text(F.try_variant_get("__v", "$.text", "variant")), "__docs": F.try_variant_get("__v", "$.documents", "array<variant>")})
    good_text = F.coalesce(~is_blank(F.col("__text")), F.lit(False))
    unauthorised = F.lit(False) if token is None else ~F.coalesce(_digest(salt, F.col("token")) == digest, F.lit(False))
    not_json = F.col("__v").isNull()
    not_object = ~F.coalesce(F.col("__kind").startswith("OBJECT"), F.lit(False))
    empty = (single & ~good_text) | (batch & (F.coalesce(F.size("__docs"), F.lit(0)) <= 0))
    bad = [(unauthorised, 401, "Unauthorised"), (~F.coalesce(single | batch, F.lit(False)), 404, "NoSuchRoute"), (F.col("n_bytes") > MAX_BYTES, 413, "TooLarge"), (not_json, 400, "InvalidJson"), (not_object, 400, "NotAnObject"), (empty, 400, "NoText")]
    status, error = F.when(bad[0][0], bad[0][1]), F.when(bad[0][0], bad[0][2])
    for test, code, name in bad[1:]:
        status, error = status.when(test, code), error.when(test, name)

    def document(d: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(F.try_variant_get(d, "$.id", "string"), F.lit("")), i.cast("string"))
        text = F.coalesce(_text(d), _text(F.try_variant_get(d, "$.text", "variant")))
        return F.struct(i.alias("ord"), name.alias("id"), F.when(~is_blank(text), text).alias("text"))

    documents = F.when(single, F.array(F.struct(F.lit(0).alias("ord"), F.lit("0").alias("id"), F.col("__text").alias("text")))).otherwise(F.transform("__docs", document))
    out = out.withColumns({"status": status.otherwise(200), "error_class": error.otherwise(None)})
    flags = {f"want_{n}": F.coalesce(F.try_variant_get("__v", f"$.{n}", "boolean"), F.lit(d)) for n, d in (("sections", True), ("fhir", False), ("reconcile", False))}
    return out.withColumns({"documents": F.when(F.col("status") == 200, documents), **flags}).drop("__v", "__kind", "__text", "__docs")


def results(checked: DataFrame) -> DataFrame:
    """A row per document of validated(): request_id, ord, id, ok, error, and for good ones entities, n_entities, sections, section_changes and disclaimer; decisions only where the request asks for them.

    Sections are found either way; findings take their section's assertion unless the request says otherwise. No shuffle, so it runs on a stream as on a table.
    """
    docs = checked.where("status = 200").select("request_id", "want_sections", "want_fhir", "want_reconcile", F.inline_outer("documents")).where("ord is not null")
    out = reconcile.with_decisions(extract.extract_documents(docs))
    plain = F.transform("entities", lambda e: F.when(F.col("want_sections") | e["section_default"].isNull(), e).otherwise(e.withField("assertion", F.lit("present")).withField("section_default", F.lit(None).cast("string"))))
    ok = F.col("text").isNotNull()
    shown = {"entities": plain, "n_entities": F.col("n_entities"), "sections": F.col("sections"), "section_changes": F.when(F.col("want_sections"), F.col("section_changes")), "decisions": F.when(F.col("want_reconcile"), F.col("decisions"))}
    return out.select("request_id", "ord", "id", ok.alias("ok"), F.when(~ok, "empty or non-string text").alias("error"), *(F.when(ok, c).alias(n) for n, c in shown.items()), "want_fhir", F.lit(DISCLAIMER).alias("disclaimer"))


def fhir_bundles(done: DataFrame) -> DataFrame:
    """A Bundle per good document of results() whose request asks for it: note_id (request and id), n_resources, json."""
    asked = done.where("ok and want_fhir").withColumn("note_id", F.concat_ws("/", "request_id", "id"))
    return fhir.bundles(asked, patient=None)


def safe_log(checked: DataFrame, done: DataFrame) -> DataFrame:
    """A row per request: ids, numbers and fixed words only. A route that is none of the service's is logged as 'other'."""
    counts = done.groupBy("request_id").agg(F.count("*").alias("n_documents"), F.sum(F.coalesce("n_entities", F.lit(0))).alias("n_entities"))
    route = F.when(F.col("route").isin(*ROUTES), F.col("route")).otherwise("other")
    return checked.withColumn("route", route).join(counts, "request_id", "left").select("request_id", "route", "status", "n_bytes", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "error_class")


def batch_summary(done: DataFrame) -> DataFrame:
    """n_documents, n_failed and n_entities of each request's documents."""
    return done.groupBy("request_id").agg(F.count("*").alias("n_documents"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum(F.coalesce("n_entities", F.lit(0))).alias("n_entities"))


TOTALS = "n_documents long, n_failed long, n_entities long"
#: What serve() observes of the requests of a batch, by name.
OBSERVED = "clinispan_requests"


def observed_totals(done: DataFrame, action: Callable[[DataFrame], None]) -> tuple[int, int, int]:
    """n_documents, n_failed and n_entities of results(), observed while action runs over them: no pass and no shuffle of their own."""
    seen = Observation()
    action(done.observe(seen, F.count("*").alias("n_documents"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("n_entities")))
    return tuple(seen.get[c.split()[0]] for c in TOTALS.split(", "))


class Totals(StreamingQueryListener):
    """Adds up what serve() observes of requests: n_requests and n_refused of each batch that ended, by its number, so that one which is reported again counts once."""

    def __init__(self):
        self.batches: dict[int, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(OBSERVED)
        if seen is not None:
            self.batches[event.progress.batchId] = (seen["n_requests"], seen["n_refused"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def sums(self) -> tuple[int, int]:
        return tuple(map(sum, zip((0, 0), *self.batches.values(), strict=True)))


def replace_batch(rows: DataFrame, path: str, n: int) -> None:
    """rows as batch n of the table at path, in place of what it had."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={n}")


def serve(requests: DataFrame, out: str, checkpoint: str, token: str | None = None):
    """Answer a stream of requests: responses, log rows and totals as Parquet under out, by micro-batches, until it is stopped.

    Each batch has a folder batch_id=N in each of the three, which is replaced as a whole: a batch that is run again, after a
    failure or from the checkpoint, leaves every response once. Requests are observed as they are validated, for a Totals listener; documents as their responses
    are written, for the table of totals. Neither reads anything twice.
    """

    def batch(rows: DataFrame, n: int) -> None:
        checked = rows.persist()
        done = results(checked).persist()
        totals = observed_totals(done, lambda df: replace_batch(df, f"{out}/responses", n))
        replace_batch(safe_log(checked, done), f"{out}/log", n)
        replace_batch(rows.sparkSession.createDataFrame([totals], TOTALS), f"{out}/totals", n)
        done.unpersist()
        checked.unpersist()

    observed = validated(requests, token).observe(OBSERVED, F.count("*").alias("n_requests"), F.count_if(F.col("status") != 200).alias("n_refused"))
    return observed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
