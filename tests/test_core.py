import datetime as dt
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import ids, similarity, temporal, text, vectors
from loomgraph.operators import chunkers, communities, extraction, graph, merge, resolve, search
from loomgraph.sources import domains, structured
from loomgraph.sources.store import KeyedTable
from loomgraph.streaming import events, limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_keys(spark):
    row = spark.createDataFrame([("  Ada  LOVELACE ", "Straße_und The-cat 42", "Zoë")], "a string, b string, c string")
    got = row.select(text.normalize_name("a"), text.tokens(F.col("b")), text.prefix_key(F.col("a")), text.soundex_key(F.col("c")), text.soundex_key(F.lit("12")), text.type_id(F.lit(" Works-At  X_"))).first()
    assert list(got) == ["ada lovelace", ["strasse", "und", "cat", "42"], "p:ada l", "s:Z000", None, "works_at_x"]


def test_uuid5_equals_the_standard(spark):
    ns = uuid.uuid4()
    assert one(spark, ids.uuid5(F.lit(str(ns)), F.lit("näme"))) == str(uuid.uuid5(ns, "näme"))
    assert one(spark, ids.document_stream(F.lit(str(ns)), F.lit(" "))) is None


@pytest.mark.parametrize(("a", "b", "score"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "a", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, score):
    assert similarity.jaro_winkler_of(a, b) == pytest.approx(score, abs=1e-4)


def test_features_renormalise(spark):
    none = F.lit(None).cast("double")
    assert one(spark, similarity.combined_score(F.lit(0.8), none, F.lit(0.0))) == pytest.approx(0.4 / 0.7)
    assert one(spark, similarity.combined_score(none, none, none)) == 0
    assert [one(spark, similarity.band(F.lit(x))) for x in (0.92, 0.91, 0.74)] == ["merge", "adjudicate", "reject"]
    empty = F.array().cast("array<string>")
    assert one(spark, similarity.graph_feature(empty, empty)) is None and one(spark, similarity.graph_feature(F.array(F.lit("x")), empty)) == 0


def test_cosine_scale(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert [one(spark, vectors.cosine_score(v(1.0, 0.0), b)) for b in (v(0.0, 1.0), v(2.0, 0.0), v(-1.0, 0.0), v(0.0, 0.0))] == [0.5, 1.0, 0.0, None]
    assert one(spark, vectors.has_zero_norm(v(1e-30, 0.0))) is True


D = dt.datetime


@pytest.mark.parametrize(("written", "start", "end", "precision", "marker"), [
    ("1914-1918", D(1914, 1, 1), D(1918, 1, 1), "year", "exact"), ("circa 1850", D(1850, 1, 1), None, "year", "circa"), ("before March 1990", D(1990, 3, 1), None, "month", "before"),
    ("Q1-Q3 2020", D(2020, 1, 1), D(2020, 7, 1), "month", "exact"), ("the 1920s", D(1920, 1, 1), D(1929, 1, 1), "year", "exact"), ("late 19th century", D(1867, 1, 1), D(1900, 1, 1), "year", "approximate"),
    ("Sept to Dec 1999", D(1999, 9, 1), D(1999, 12, 1), "month", "exact"), ("4 July 1776", D(1776, 7, 4), None, "day", "exact"),
])
def test_dates(spark, written, start, end, precision, marker):
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    e = temporal.parse(F.lit(written))
    got = spark.range(1).select(show(e["start_date"]), show(e["end_date"]), e["precision"], e["uncertainty"]).first()
    assert list(got) == [start.date().isoformat(), end and end.date().isoformat(), precision, marker]


def test_dates_that_are_refused(spark):
    rows = spark.createDataFrame([("1918-1914",), ("",), ("March",), ("gibberish",), ("x" * 600,), (None,)], "t string")
    got = rows.select(temporal.parse(F.col("t")).alias("e"), temporal.is_ambiguous(F.col("t")).alias("a")).collect()
    assert all(r.e is None for r in got) and [r.a for r in got] == [False, False, True, False, False, False]


moments = st.one_of(st.none(), st.integers(0, 6))


def relation(a, b):
    lo = lambda x: -99 if x is None else x
    up = lambda x: 99 if x is None else x
    (al, au), (bl, bu) = (lo(a[0]), up(a[1])), (lo(b[0]), up(b[1]))
    return "equals" if (al, au) == (bl, bu) else "before" if au <= bl else "after" if bu <= al else "during" if bl <= al and au <= bu else "contains" if al <= bl and bu <= au else "overlaps"


def test_relations(spark):
    spans = [(a, b) for a in (None, 0, 1, 2, 3) for b in (None, 1, 2, 3, 4) if a is None or b is None or a < b]
    pairs = [(*x, *y) for x in spans for y in spans]
    at = lambda c: F.timestamp_seconds(c)
    b = lambda x, y: F.struct(at(F.col(x)).alias("lower"), at(F.col(y)).alias("upper"))
    rows = spark.createDataFrame(pairs, "a int, b int, c int, d int").select("*", temporal.relate(b("a", "b"), b("c", "d")).alias("r")).collect()
    assert all(r.r == relation((r.a, r.b), (r.c, r.d)) for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB .!?\n,", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text(text, size, overlap):
    for cut in (chunkers.sliding, chunkers.preferring):
        spans = cut(text, size, overlap)
        if not text.strip():
            assert spans == []
            continue
        assert spans[0][1] == 0 and spans[-1][2] == len(text) and [s[0] for s in spans] == list(range(len(spans)))
        assert all(b[1] <= a[2] and a[1] < b[1] and b[2] > a[2] and s[2] - s[1] <= size for a, b, s in zip(spans, spans[1:], spans))


def test_communities_of_two_cliques():
    clique = lambda names: [(a, b, 1.0) for a in names for b in names if a < b]
    found = communities.detect("abcdefgz", [*clique("abcd"), *clique("efg"), ("d", "e", 0.5)])
    assert found == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efg", "e"), "z": "z"}


def test_consolidation_is_no_closure():
    assert resolve.fold_pass([("a", "b", 0.95), ("b", "c", 0.95)]) == [("a", "b", 0.95)]


def test_aliases_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "alias int, canonical int")
    assert {r.canonical for r in graph.resolve_aliases(chain).collect()} == {0}
    with pytest.raises(LookupError):
        graph.resolve_aliases(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "alias int, canonical int"))


def test_strategies(spark):
    rows = [("g", "properties.k", i, v, t, 0.5, str(i)) for i, v, t in ((0, ["a"], 5), (1, ["b", "a"], 9), (2, ["c"], 1))]
    claims = spark.createDataFrame(rows, "g string, path string, ordinal int, value array<string>, observed_at int, confidence double, origin string")
    got = {s: merge.resolve(claims, ["g", "path"], overrides={"properties": s}).first().values for s in merge.STRATEGIES}
    assert got == {"prefer_canonical": ["a"], "prefer_merged": ["b", "a"], "union": ["a", "b", "c"], "most_recently_observed": ["b", "a"]}
    for bad in ({"default": "union"}, {"overrides": {"description": "union"}}, {"overrides": {"name": "union"}}):
        with pytest.raises(ValueError):
            merge.check_policy(bad.get("default", "prefer_canonical"), bad.get("overrides", {}))


def test_redirect_and_undo(spark):
    edges = spark.createDataFrame([("1", "a", "b", "t"), ("2", "c", "b", "t"), ("3", "a", "c", "t"), ("4", "x", "y", "t")], "id string, src string, dst string, type string")
    plan = merge.plan_redirections(edges, spark.createDataFrame([("c", "a")], "absorbed string, canonical string"))
    assert sorted((r.id, r.after_src, r.after_dst) for r in plan.collect()) == [("1", None, None), ("2", "a", "b"), ("3", None, None)]
    after = merge.apply_redirections(edges, plan)
    assert sorted(r.id for r in after.collect()) == ["2", "4"]
    assert sorted(map(tuple, merge.undo_redirections(after, plan).collect())) == sorted(map(tuple, edges.collect()))


def test_keyed_table(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", "s", 1, 0), ("t", "a", "s", 2, 1), ("t", "b", "s", 3, 2), ("u", "a", "s", 4, 3)], "tenant_id string, id string, source_id string, v int, nth int")
    table = KeyedTable(spark, str(tmp_path / "k"), rows.drop("nth").schema)
    table.upsert(rows, "nth")
    assert sorted((r.tenant_id, r.id, r.v) for r in table.read().collect()) == [("t", "a", 2), ("t", "b", 3), ("u", "a", 4)]
    assert table.replace_source("t", "s", rows.filter("v = 1").drop("nth")) == 1 and table.delete_where("u") == 1
    assert [(r.id, r.v) for r in table.read().collect()] == [("a", 1)] and table.delete(table.read()) == 1


def test_structured_entities():
    item = '{"@type": ["Person"], "name": "Ada", "sameAs": "http://x", "worksFor": {"@type": "NGO", "name": "Org"}, "url": {"@value": "u"}}'
    a, b = structured.json_ld_entities(item)
    assert (a["type"], a["name"], b["type"], b["name"]) == ("person", "Ada", "organization", "Org") and '"url": "u"' in a["properties"]
    assert structured.json_ld_entities("{") == [] and structured.json_ld_entities('[{"name": "no type"}]') == []


def test_domains():
    with pytest.raises(ValueError):
        domains.validate({"domain_id": "x", "display_name": "X", "entity_types": [{"id": "a"}], "relationship_types": [{"id": "r", "valid_source_types": ["zz"]}]})


def test_extraction_maps_and_drops(spark):
    def model(_):
        e = lambda n, t, c: {"name": n, "entity_type": t, "description": None, "confidence": c, "temporal_expression": None, "properties": {}}
        r = lambda a, b: {"source_name": a, "target_name": b, "relationship_type": "knows", "confidence": 0.5, "properties": {}}
        return {"entities": [e("Ada", "person", 0.5), e("ADA ", "person", 0.9), e("Bob", "person", 0.5), e(" ", "person", 1.0)], "relationships": [r("ada", "Bob"), r("Ada", "ADA"), r("Ada", "Eve")]}
    chunks = spark.createDataFrame([(str(uuid.UUID(int=1)), "d", 0, "x")], "tenant_id string, source_id string, chunk_index int, text string")
    built = extraction.build_graph(chunks, model)
    assert sorted((r.name, r.confidence) for r in built["entities"].collect()) == [("ADA ", 0.9), ("Bob", 0.5)]
    assert built["edges"].count() == 1 and {r.why: r.n for r in built["dropped"].collect()} == {"loop": 1, "unresolved": 1}


def test_fuse_and_modes(spark):
    r = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "id string, score double")
    got = {x.id: x for x in search.fuse({"x": r, "y": r.filter("id = 'b'")}).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61) and got["a"].y_score is None
    with pytest.raises(ValueError):
        search.retrieve_chunks(["a"], "a", 1, chunks=r, mode="semantic")


def test_admission_refuses_without_recording(spark):
    hits = spark.createDataFrame([("t", s, i) for i, s in enumerate((0, 10, 20, 59, 61))], "tenant string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.admitted for r in limits.admissions(hits, 2).orderBy("event_id").collect()] == [True, True, False, False, True]
    breaker = limits.Breaker(2, 10)
    states = []
    for t, ok in ((0, False), (1, False), (2, True), (12, True)):
        if breaker.allow(t):
            breaker.record(ok, t)
        states.append(breaker.state)
    assert states == ["closed", "open", "open", "closed"]


def test_stream_replays_to_the_same_rows(spark, tmp_path):
    def event(p, kind, payload):
        return (p, "t", "s", 1, kind, payload)
    log = [event(1, "extracted", '{"model":"m","entities":[{"id":"a","name":"A","entity_type":"x"},{"id":"b","name":"B","entity_type":"x"},{"id":"c","name":"C","entity_type":"x"}],"edges":[{"id":"e","src":"b","dst":"c","type":"k"}]}'),
           event(2, "extracted", '{"model":"m","entities":[{"id":"z","name":"Z","entity_type":"x"}],"edges":[]}'), event(3, "merged", '{"event_id":"m1","canonical":"a","absorbed":["b"],"redirections":[{"before":{"id":"e","src":"b","dst":"c","type":"k"},"after":{"id":"e","src":"a","dst":"c","type":"k"}}]}'),
           event(4, "merged", '{"event_id":"m2","canonical":"a","absorbed":["c"]}'), event(5, "undone", '{"event_id":"m2"}')]
    frame = spark.createDataFrame(log, events.LOG)
    frame.unionByName(frame.limit(1)).write.json(str(tmp_path / "in"))
    events.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    for folded in (events.project(frame), events.project(events.read(spark, str(tmp_path / "out")))):
        assert sorted(r.id for r in folded["entities"].collect()) == ["a", "b", "c"]
        assert [(r.src, r.dst) for r in folded["edges"].collect()] == [("a", "c")]


def test_registry():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
