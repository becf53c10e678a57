"""Steps that must not gather, pair or repeat what grows with the input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import similarity
from loomgraph.operators import communities, consolidate, extraction, graph, lexical, resolve

EDGE = "id string, src string, dst string, type string, confidence double, properties map<string,string>"
MEMBER = "id string, description string, external_ids map<string,string>, properties map<string,array<string>>, observed_at timestamp, confidence double"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_a_merge_are_rows(spark):
    edges = spark.createDataFrame([(str(k), f"s{k % 4}", f"p{k}", "supplies", 0.5 + k % 2 / 10, {}) for k in range(12)], EDGE)
    asked = spark.createDataFrame([("m", "p0", [f"p{k}" for k in range(1, 12)])], "event_id string, canonical string, absorbed array<string>")
    flat = consolidate.plan_edges(asked, edges)
    assert "collect_list" not in plan_of(flat) and "collect_list" not in plan_of(consolidate.tally(asked, flat))
    members = spark.createDataFrame([(f"p{k}", None, {}, {}, None, 0.5) for k in range(12)], MEMBER)
    whole = consolidate.plan_merges(asked, members, edges, spark.createDataFrame([], "alias string"))
    key = lambda r: (r.before.id, r.before.dst, r.after and r.after.dst)
    assert sorted(map(key, flat.collect())) == [key(r) for r in whole.first().redirections]
    assert consolidate.tally(asked, flat).collect() == consolidate.report(whole).collect()


def test_names_compared_at_once():
    rng = random.Random(3)
    some = lambda: ["".join(rng.choice("abcé ") for _ in range(rng.randrange(24))) for _ in range(60)]
    a, b = [*some(), "x" * 70 + "ab", "é" * 64], [*some(), "x" * 71, "é" * 63 + "f"]
    assert similarity.jaro_winkler_matrix(a, b).tolist() == [[similarity.jaro_winkler_of(x, y) for y in b] for x in a]
    sets = lambda: [np.array(rng.sample(range(30), rng.randrange(9)), np.int64) for _ in range(12)]
    x, y = sets(), sets()
    assert similarity.shared_counts(x, y, 4).tolist() == [[len(set(p) & set(q)) for q in y] for p in x]


NAMED = "tenant_id string, id string, name string, entity_type string, blocking_keys array<string>"


def named_rows(n):
    rng = random.Random(5)
    names = [" ".join(rng.choice(["red", "blue", "ring", "Ring", "bolt", "nut"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return [("t", f"{'pq'[k % 2]}{k:03d}", x, "thing", [f"p:{x[:2]}", *(["t:thing"] if k % 3 else [])]) for k, x in enumerate(names)]


def test_pairs_come_once_and_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PART", 16)
    monkeypatch.setattr(resolve, "SLICE", 5)
    rows = named_rows(70)
    named = spark.createDataFrame(rows, NAMED)
    around = spark.createDataFrame([(r[1], sorted({f"n{k % 4}", f"m{k % 7}"})) for k, r in enumerate(rows) if k % 5], "id string, names array<string>")
    near = spark.createDataFrame([("t", rows[k][1], rows[k + 2][1], k / 100) for k in range(60)], "tenant_id string, a string, b string, embedding double")
    found = resolve.compared_pairs(named, ("name", "embedding", "graph"), around, near)
    got = sorted(map(tuple, found.collect()), key=lambda r: r[:3])
    pairs = [("t", x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and set(x[4]) & set(y[4])]
    want = resolve.features(spark.createDataFrame(pairs, "tenant_id string, a string, b string"), named, around, near).select("tenant_id", "a", "b", "name", "embedding", "graph")
    assert got == sorted(map(tuple, want.collect()), key=lambda r: r[:3])
    assert sorted(map(tuple, resolve.blocked_pairs(named).collect())) == sorted(pairs)
    assert "Distinct" not in (plan := plan_of(found)) and plan.index("FlatMapGroupsInArrow") < plan.index("Join")


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_consolidation_by_rounds_is_the_ordered_pass(spark, monkeypatch, least):
    monkeypatch.setattr(resolve, "PART", 16)
    monkeypatch.setattr(resolve, "LEADERS", 9)
    named = spark.createDataFrame(named_rows(60), NAMED)
    confirm = lambda s: s.filter(F.col("score") >= least).select("tenant_id", "a", "b", "score")
    pairs = confirm(resolve.scored(resolve.features(resolve.blocked_pairs(named), named)))
    want = {x[:2] for x in resolve.fold_pass([tuple(x) for x in pairs.select("a", "b", "score").collect()])}
    rounds = resolve.consolidate(named, confirm)
    assert want and {(x.canonical, x.absorbed) for x in rounds.collect()} == want


def test_every_entity_is_consolidated():
    assert "entity_type <> 'customer'" not in __spark_entry__.oracle_sql()["consolidation_pass"]


def test_texts_that_redaction_shortens_are_asked_about(spark):
    text = "A bcmiagkc.41@mail7.example.com the blereen blehe the."
    docs = spark.createDataFrame([(1, text), (2, "x" * 49 + " "), (3, None)], "doc_id long, text string")
    said = {r.doc_id: r.domain for r in extraction.classify(docs, lambda t: ("a", 1.0), ["a"]).collect()}
    assert said == {1: "a", 2: "general", 3: "general"}


def test_documents_with_carryover_share_a_task(spark):
    told = lambda text: {"entities": [{"name": text, "entity_type": "x", "description": None, "confidence": 0.5, "temporal_expression": None, "properties": {}}], "relationships": []}
    chunks = spark.createDataFrame([("t", f"d{k % 3}", k // 3, f"{k}") for k in range(12)], "tenant_id string, source_id string, chunk_index int, text string")
    answered = extraction.answers(chunks, told, carryover=2)
    assert "FlatMapGroups" not in plan_of(answered)
    got = {(r.source_id, r.chunk_index): r.entities[0]["name"] for r in answered.collect()}
    assert len(got) == 12 and got["d2", 0] == "2" and got["d2", 1].endswith("\n5") and '"2"' in got["d2", 1] and '"1"' not in got["d2", 1]


def test_frontiers_meet_edges_as_they_are(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("a", "a")], "src string, dst string")
    found = graph.neighbors(edges, spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 1), ("a", "c", 2)]
    once = plan_of(graph.neighbors(edges, spark.createDataFrame([("a",)], "id string"), 1))
    assert not re.search(r"Aggregate \[src", once)


def test_communities_of_any_graph_stay(spark):
    rng = random.Random(2)
    nodes = [f"n{k:02d}" for k in range(40)]
    for weights in ([1.0], [0.5, 1.0, 2.0]):
        links = [(rng.choice(nodes), rng.choice(nodes), rng.choice(weights)) for _ in range(90)]
        frame = spark.createDataFrame([("t", *x) for x in links] + [("u", "n01", "n00", 1.0)], "tenant_id string, src string, dst string, weight double")
        of = spark.createDataFrame([(t, n) for t in "tu" for n in nodes], "tenant_id string, id string")
        got = {(r.tenant_id, r.id): r.community for r in communities.communities(of, frame).collect()}
        want = communities.detect(nodes, links)
        assert {n: got["t", n] for n in nodes} == want and got["u", "n01"] == "n00" and got["u", "n02"] == "n02"
    assert "FlatMapGroupsInPandas" not in plan_of(communities.communities(of, frame))


def test_index_rows_are_those_of_the_term_table(spark):
    texts = ["b a b the", "", None, "the of", "Straße strasse x1 x1 x1", " ".join(f"w{k % 7}" for k in range(500))]
    rows = spark.createDataFrame([("t", str(k), x) for k, x in enumerate(texts)], "tenant_id string, id string, text string")
    made = lexical.index_rows(rows)
    want = lexical.term_table(rows).join(lexical.lengths(rows), ["tenant_id", "id"]).select("tenant_id", "id", "term", "tf", "doc_length")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.dtypes == want.dtypes
    assert "Aggregate" not in plan_of(made) and "Join" not in plan_of(made)
