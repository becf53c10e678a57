import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import temporal
from loomgraph.operators import calls, compose, extraction, ranking, resolve
from loomgraph.sources import shared, structured
from loomgraph.sources.store import ConcurrentWrite, KeyedTable, PassageStore
from loomgraph.streaming import events

ROW = "tenant_id string, id string, v int"


def test_a_write_leaves_other_tenants_files_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), ROW)
    table.upsert(spark.createDataFrame([("a/b=c", "1", 1), ("t", "1", 2)], ROW))
    before = table._manifest()[1]
    table.upsert(spark.createDataFrame([("t", "2", 3)], ROW))
    after = table._manifest()[1]
    assert before["a/b=c"] == after["a/b=c"] and before["t"] != after["t"]
    assert sorted((r.tenant_id, r.id, r.v) for r in table.read().collect()) == [("a/b=c", "1", 1), ("t", "1", 2), ("t", "2", 3)]
    assert table.read("a/b=c").count() == 1 and table.read("nobody").count() == 0 and table.delete_where("a/b=c") == 1 and table.read("a/b=c").count() == 0
    assert table.vacuum() == 1 and table.read().count() == 2


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), ROW)
    rows = spark.createDataFrame([("t", "1", 1)], ROW)
    table.upsert(rows)
    number, versions = table._manifest()
    table.upsert(rows.withColumn("v", F.lit(2)))
    with pytest.raises(ConcurrentWrite):
        table._commit(number, versions, rows, ["t"])
    assert table.read().first().v == 2


def test_replacing_sources_at_once(spark, tmp_path):
    store = PassageStore(spark, str(tmp_path / "p"))
    docs = spark.createDataFrame([("t", "a", "one"), ("t", "b", "two"), ("t", "c", None)], "tenant_id string, source_id string, text string")
    assert {r.source_id: (r.passages, r.lost) for r in compose.index_documents(docs, store).collect()} == {"a": (1, 0), "b": (1, 0)}
    again = compose.index_documents(docs.withColumn("text", F.when(F.col("source_id") == "a", "changed").otherwise(F.col("text"))), store)
    assert {r.source_id: (r.passages, r.lost) for r in again.collect()} == {"a": (1, 1), "b": (1, 0)}
    assert sorted(r.term for r in store.terms.read().collect()) == ["changed", "two"] and store.backfill() == 2
    with pytest.raises(ValueError):
        store.replace_sources(store.read(), spark.createDataFrame([("t", "a")], "tenant_id string, source_id string"))


def test_partial_extraction_is_refused_unless_allowed(spark):
    docs = spark.createDataFrame([("00000000-0000-5000-8000-000000000001", "a", "Ada met Bob."), ("00000000-0000-5000-8000-000000000001", "b", "fail")], "tenant_id string, source_id string, text string")

    def model(text):
        if "fail" in text:
            raise RuntimeError
        return extraction.fake_model(text)

    with pytest.raises(compose.PartialExtraction):
        compose.build_graph(docs, model, calendar=False)
    built = compose.build_graph(docs, model, calendar=False, allow_partial=True)
    assert sorted(r.name for r in built["entities"].collect()) == ["Ada", "Bob"] and built["failed"].count() == 1


def test_carryover_goes_in_batches(spark):
    seen = []

    def model(text):
        return {"entities": [{"name": text[-1], "entity_type": str(text.count('"x"')), "description": None, "confidence": 0.5, "temporal_expression": None, "properties": {}}], "relationships": []}

    chunks = spark.createDataFrame([("t", "d", k, f"{k}") for k in range(4)], "tenant_id string, source_id string, chunk_index int, text string")
    for batch in (1, 2):
        rows = extraction.answers(chunks, lambda t: {**model(t), "entities": [{**model(t)["entities"][0], "entity_type": str(len(t.split("\n")))}]}, carryover=8, batch=batch).orderBy("chunk_index").collect()
        seen.append([r.entities[0].entity_type for r in rows])
    assert seen == [["1", "2", "2", "2"], ["1", "1", "2", "2"]]


def test_nearest_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SUBJECTS", 7)
    monkeypatch.setattr(resolve, "VECTORS", 11)
    r = random.Random(4)
    vectors = [(f"v{i:02d}", [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(40)] + [("zero", [0.0] * 4)]
    frame = spark.createDataFrame([("t", i, v) for i, v in vectors], "tenant_id string, id string, embedding array<float>")
    pairs = spark.createDataFrame([("t", i) for i, _ in vectors if i != "v07"], "tenant_id string, a string")
    want = set()
    for a, x in vectors:
        if a == "v07" or not any(x):
            continue
        scores = sorted((-round((1 + np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))) / 2, 12), b) for b, y in vectors if any(y))
        want |= {(a, b) for _, b in scores[:5]}
    assert {(x.a, x.b) for x in resolve.nearest(pairs, frame, 5).collect()} == want


def test_places_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "id int, v int")
    got = {x.id: x.place for x in ranking.placed(rows, F.desc("v"), "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (-(i % 7), i)) and sorted(got.values()) == list(range(1, 501))
    assert ranking.placed(rows.limit(0), "id").count() == 0


def test_retries_and_ceiling():
    waits, calls_made = [], []

    @calls.with_retry(KeyError, retries=2, wait=waits.append)
    def flaky(kind):
        calls_made.append(kind)
        raise kind

    for kind, made, waited in ((KeyError, 3, [1.0, 2.0]), (ValueError, 1, [])):
        calls_made.clear()
        waits.clear()
        with pytest.raises(kind):
            flaky(kind)
        assert len(calls_made) == made and waits == waited
    assert calls.delay_of(10) == 60 and calls.delay_of(0, jitter=0.5, draw=lambda: 0.0) == 0.5
    assert calls.CallLimiter(1)(lambda x: x + 1, 2) == 3
    with pytest.raises(ValueError):
        calls.CallLimiter(0)
    counter = calls.ExpiringCounter(10)
    assert [counter.increment("k", t) for t in (0, 5, 9, 10, 11)] == [1, 2, 3, 1, 2]


def test_event_log_snapshots(spark, tmp_path):
    log = events.EventLog(spark, str(tmp_path / "l"), every=2)
    row = lambda p, v, kind, payload: (p, "t", "s", v, kind, payload)
    merged = lambda i, c, a: f'{{"event_id":"{i}","canonical":"{c}","absorbed":["{a}"]}}'
    assert log.append(spark.createDataFrame([row(1, 1, "merged", merged("x", "a", "b"))], events.LOG)) == 1
    assert log.append(spark.createDataFrame([row(1, 2, "merged", merged("y", "a", "c")), row(2, 3, "undone", '{"event_id":"x"}')], events.LOG)) == 3
    assert log._segments()[1]["snapshot"] and [r.event_id for r in log.merges().collect()] == ["y"]
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([row(1, 3, "merged", "{}")], events.LOG))
    bad = spark.createDataFrame([row(1, 1, "undone", '{"event_id":"never"}')], events.LOG)
    with pytest.raises(LookupError):
        events.require_sound(bad)
    with pytest.raises(LookupError):
        events.project(spark.createDataFrame([row(1, 1, "merged", '{"event_id":"x","canonical":"a","absorbed":["b"],"resolution":{"entity_id":"a","after":{"description":"d"}}}')], events.LOG), strict=True)


def test_meta_attributes_in_any_order(spark):
    html = "<META content='A > B' property=og:title /><meta name=\"og:type\" content=\"book\"><meta property='og:title' content='second'><meta name=viewport content=x>"
    row = spark.createDataFrame([(html,)], "html string").select(structured.open_graph_of(F.col("html")).alias("m")).first()
    assert row.m == {"title": "A > B", "type": "book"}


def test_relative_dates_need_a_reference(spark):
    frame = spark.createDataFrame([("3 days ago",), ("in an hour",), ("last month",), ("whenever",)], "t string")
    base = F.lit("2020-03-31 12:00:00").cast("timestamp")
    got = [r[0] and str(r[0]) for r in frame.select(temporal.parse(F.col("t"), base)["start_date"]).collect()]
    assert got == ["2020-03-28 12:00:00", "2020-03-31 13:00:00", "2020-02-29 12:00:00", None]
    assert all(r[0] is None for r in frame.select(temporal.parse(F.col("t"))["start_date"]).collect())


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
