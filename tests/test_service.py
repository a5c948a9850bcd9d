import json

import pytest
from pyspark.sql import functions as F

from clinispan.streaming import service

REQUESTS = [
    ("r1", "/extract", None, json.dumps({"text": "No fever. PMH: asthma."})),
    ("r2", "/extract", None, "{not json"),
    ("r3", "/extract", None, json.dumps({"text": "  \n\t"})),
    ("r4", "/extract", None, json.dumps({"text": "x" * 200_001})),
    ("r5", "/extract/batch", None, json.dumps({"documents": ["Cough.", {"id": "a", "text": "Fever."}, {"id": "", "text": ""}, 7, {"text": 5}], "reconcile": True, "fhir": True})),
    ("r6", "/secret/Jane-Roe", None, "{}"),
    ("r7", "/extract", None, "[1]"),
    ("r8", "/extract/batch", None, json.dumps({"documents": []})),
    ("r9", "/extract", None, json.dumps({"text": "PMH: asthma.\nAlso GERD.", "sections": False})),
    ("r10", "/extract", None, None),
]


@pytest.fixture(scope="module")
def done(spark):
    checked = service.validated(spark.createDataFrame(REQUESTS, service.REQUEST)).cache()
    return checked, service.results(checked).cache()


def test_statuses(done):
    got = {r["request_id"]: (r["status"], r["error_class"]) for r in done[0].collect()}
    assert got == {"r1": (200, None), "r2": (400, "InvalidJson"), "r3": (400, "NoText"), "r4": (413, "TooLarge"), "r5": (200, None), "r6": (404, "NoSuchRoute"), "r7": (400, "NotAnObject"), "r8": (400, "NoText"), "r9": (200, None), "r10": (400, "InvalidJson")}


def test_bad_documents_do_not_fail_their_batch(done):
    rows = {r["ord"]: r for r in done[1].where("request_id = 'r5'").collect()}
    assert [(rows[i]["id"], rows[i]["ok"]) for i in range(5)] == [("0", True), ("a", True), ("2", False), ("3", False), ("4", False)]
    assert service.batch_summary(done[1]).where("request_id = 'r5'").first()[1:] == (5, 3, 2)
    assert rows[0]["decisions"][0]["confidence"] == "single"
    assert service.fhir_bundles(done[1]).count() == 2


def test_sections_only_where_wanted(done):
    by = {r["request_id"]: r for r in done[1].where("request_id in ('r9')").collect()}
    assert [e["assertion"] for e in by["r9"]["entities"]] == ["historical", "present"]
    assert by["r9"]["section_changes"] is None


def test_log_has_no_text(done):
    log = service.safe_log(*done)
    assert tuple(log.columns) == service.LOG_FIELDS
    text = "\n".join(log.toJSON().collect())
    for secret in ("fever", "asthma", "Jane", "secret", "not json"):
        assert secret not in text
    assert service.health(log).first()["logged_requests"] == len(REQUESTS)


def test_token(spark):
    rows = [("a", "/extract", "Bearer s", '{"text": "Cough."}'), ("b", "/extract", "Bearer t", '{"text": "Cough."}'), ("c", "/extract", None, '{"text": "Cough."}')]
    got = {r["request_id"]: r["status"] for r in service.validated(spark.createDataFrame(rows, service.REQUEST), "s").collect()}
    assert got == {"a": 200, "b": 401, "c": 401}


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    spark.createDataFrame(REQUESTS, service.REQUEST).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(service.REQUEST).json(str(tmp_path / "in"))
    query = service.serve(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out/log")).count() == len(REQUESTS)
    assert spark.read.parquet(str(tmp_path / "out/responses")).agg(F.sum("n_entities")).first()[0] == 6


def test_a_batch_that_is_run_again_leaves_each_response_once(spark, tmp_path):
    """A batch called twice, then a restart from the checkpoint with more requests; totals by batch are those of the responses."""
    rows = spark.createDataFrame(REQUESTS, service.REQUEST)
    done = service.results(service.validated(rows))
    for _ in range(2):
        service.replace_batch(done, str(tmp_path / "twice"), 4)
    assert spark.read.parquet(str(tmp_path / "twice")).count() == done.count()

    totals = service.Totals()
    spark.streams.addListener(totals)
    rows.where("request_id in ('r1', 'r2', 'r5')").write.json(str(tmp_path / "in"))
    for more in (None, rows.where("request_id = 'r9'")):
        if more is not None:
            more.write.mode("append").json(str(tmp_path / "in"))
            # As after a failure before the batch was recorded as done: it is run again.
            for f in (tmp_path / "ck/commits").glob("*0*"):
                f.unlink()
        query = service.serve(spark.readStream.schema(service.REQUEST).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
    responses = spark.read.parquet(str(tmp_path / "out/responses"))
    assert sorted(r["request_id"] for r in responses.select("request_id").distinct().collect()) == ["r1", "r5", "r9"]
    assert responses.groupBy("request_id", "ord").count().where("count > 1").count() == 0 and responses.count() == 7
    assert spark.read.parquet(str(tmp_path / "out/log")).count() == 4
    kept = spark.read.parquet(str(tmp_path / "out/totals")).agg(F.sum("n_documents"), F.sum("n_failed"), F.sum("n_entities")).first()
    assert tuple(kept) == tuple(service.batch_summary(responses).agg(F.sum("n_documents"), F.sum("n_failed"), F.sum("n_entities")).first())
    assert totals.sums == (4, 1)
    spark.streams.removeListener(totals)


def test_observed_totals_are_those_of_the_summary(done):
    seen = service.observed_totals(done[1], lambda df: df.write.format("noop").mode("overwrite").save())
    assert seen == tuple(service.batch_summary(done[1]).agg(F.sum("n_documents"), F.sum("n_failed"), F.sum("n_entities")).first())
