"""The registered queries of the graph, search, time, resolution and log operators, each over its whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import ids, temporal, text, vectors
from loomgraph.operators import chunkers, communities, evaluate, graph, intervals, lexical, merge, resolve, search
from loomgraph.plans import recursive_sql
from loomgraph.plans.registry import STAMP, query, r6, stamp
from loomgraph.operators.ranking import placed
from loomgraph.sources import domains, store, structured
from loomgraph.sources.shared import materialise
from loomgraph.sources.tables import EDGE_SQL, ENTITY_SQL, TENANT, aliases, edges, entities, part_names, table
from loomgraph.streaming import limits

TERMS = ["erble", "nicht", "thing", "thatin"]
VECTOR = [(i % 7 - 3) / 16 for i in range(64)]
PART_QUERY = "small ring"


_TOKENS = r"list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"
_TERM_LIST = ", ".join(f"('{t}')" for t in TERMS)
_VECTOR = "[" + ", ".join(str(x) for x in VECTOR) + "]::DOUBLE[]"
_COSINE = f"least(1, greatest(0, (1 + list_dot_product(embedding::DOUBLE[], {_VECTOR}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_VECTOR}, {_VECTOR})))) / 2))"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage a document; its language is the tenant."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.col("doc_id").alias("id"), "text")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one tenant."""
    return passages(spark, sf_dir).withColumn("tenant_id", F.lit(TENANT))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("tenant_id"), F.col("vec_id").alias("id"), F.concat(F.lit("label_"), "label").alias("entity_type"), "embedding")


# --- passages

_BM25 = f"""
d AS (SELECT doc_id AS id, {_TOKENS} AS words FROM documents), s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
q AS (SELECT * FROM (VALUES {_TERM_LIST}) v(term)),
tf AS (SELECT id, len(words) AS dl, term, len(list_filter(words, lambda w: w = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
scored AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id)"""


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(whole(spark, sf_dir), TERMS, 20).select("id", r6(F.col("score")).alias("score"))


@query(f"SELECT lang AS tenant_id, doc_id AS id, term, count(*) AS tf FROM (SELECT lang, doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_table(passages(spark, sf_dir))


@query(f"SELECT lang AS tenant_id, count(*) AS n_docs, round(avg(len({_TOKENS})), 6) AS avg_doc_length FROM documents GROUP BY lang")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(passages(spark, sf_dir)).select("tenant_id", "n_docs", r6(F.col("avg_doc_length")).alias("avg_doc_length"))


@query(f"""SELECT lang AS tenant_id, term, count(*) FILTER (WHERE list_contains(words, term)) AS df
FROM (SELECT lang, {_TOKENS} AS words FROM documents), (VALUES {_TERM_LIST}) v(term) GROUP BY ALL""")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(passages(spark, sf_dir), lexical.query_terms(spark, TERMS))


@query("SELECT doc_id, sha256(encode(CAST(doc_id AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.chunk_id(F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id"))


_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{_DNS.replace("-", "")}') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17:17])::INT % 4 + 1 AS INT), 1) || h[18:20] || '-' || h[21:32] AS stream_id FROM h""")
def document_stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.document_stream(F.lit(_DNS), F.col("doc_id").cast("string")).alias("stream_id"))


_REDACTED = "text"
for _pattern, _mark in text.REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_mark}', 'g')"


@query(f"SELECT doc_id, {_REDACTED} AS text FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.col("doc_id").cast("string").alias("source_id"), "text")


@query(recursive_sql.CHUNK_SLIDING)
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunks(_sources(spark, sf_dir)).drop("text")


@query(recursive_sql.CHUNK_BOUNDARY)
def chunk_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunks(_sources(spark, sf_dir), chunkers.preferring).drop("text")


@query(recursive_sql.CHUNKING_DIGESTS)
def chunking_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunking_digest(chunkers.chunks(_sources(spark, sf_dir)))


# --- vectors and fusion

_KNN = "SELECT vec_id AS id, {cos} AS score FROM embeddings"


@query(f"SELECT id, round(score, 6) AS score FROM ({_KNN.format(cos=_COSINE)}) ORDER BY 2 DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(vector_table(spark, sf_dir), VECTOR, 10).select("id", r6(F.col("score")).alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_KNN.format(cos=_COSINE)} WHERE label IN (1, 3) AND label % 2 = 1) ORDER BY 2 DESC, id LIMIT 10")
def vector_topk_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(vector_table(spark, sf_dir), VECTOR, 10, tenant_id=1, types=["label_1", "label_3"]).select("id", r6(F.col("score")).alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_KNN.format(cos=_COSINE)}) WHERE score >= 0.55")
def vector_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(vector_table(spark, sf_dir), VECTOR, None, min_score=0.55).select("id", r6(F.col("score")).alias("score"))


@query("SELECT vec_id AS id, len(list_filter(embedding, lambda x: CAST(x * x AS FLOAT) <> 0)) = 0 AS zero FROM embeddings")
def zero_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_table(spark, sf_dir).select("id", vectors.has_zero_norm(F.col("embedding")).alias("zero"))


@query(f"""WITH {_BM25}, l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored QUALIFY rn <= 60),
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM ({_KNN.format(cos=_COSINE)}) QUALIFY rn <= 60)
SELECT id, round(sum(1.0 / (60 + rn)), 6) AS score, round(max(CASE WHEN c = 'v' THEN s END), 6) AS semantic_score, round(max(CASE WHEN c = 'l' THEN s END), 6) AS lexical_score
FROM (SELECT id, rn, score AS s, 'l' AS c FROM l UNION ALL SELECT id, rn, score, 'v' FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + rn)) DESC, id LIMIT 20""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {"semantic": search.knn(vector_table(spark, sf_dir), VECTOR, 60).select("id", "score"), "lexical": lexical.rank(whole(spark, sf_dir), TERMS, 60).select("id", "score")}
    return search.fuse(found, 20).select("id", *[r6(F.col(c)).alias(c) for c in ("score", "semantic_score", "lexical_score")])


@query("""WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rn FROM part)
SELECT a.id, round(1.0 / (60 + a.rn) + 1.0 / (60 + b.rn), 8) AS score FROM a JOIN b USING (id)""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    fused = search.fuse({"price": part.select("id", F.col("p_retailprice").alias("score")), "size": part.select("id", F.col("p_size").cast("double").alias("score"))})
    return fused.select("id", F.round("score", 8).alias("score"))


# --- graph


@query(f"WITH {ENTITY_SQL} SELECT id, name FROM v_entity WHERE entity_type = 'customer' AND id > 'c100' ORDER BY id LIMIT 50")
def find_entities_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_entities(entities(spark, sf_dir), TENANT, entity_type="customer", after="c100", limit=50).select("id", "name")


@query(f"WITH {ENTITY_SQL} SELECT id, name, entity_type FROM v_entity WHERE id IN (SELECT 'c' || o_custkey FROM orders)")
def entities_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"))
    return graph.get_entities(entities(spark, sf_dir), asked).select("id", "name", "entity_type")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))


_AT_NATIONS = "(SELECT 'n' || n_nationkey FROM nation)"


@query(f"WITH {EDGE_SQL} SELECT id, src, dst, type FROM v_edge WHERE src IN {_AT_NATIONS}")
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(edges(spark, sf_dir), _nations(spark, sf_dir), direction="out")


@query(f"WITH {EDGE_SQL} SELECT id, src, dst, type FROM v_edge WHERE dst IN {_AT_NATIONS} AND type = 'located_in'")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(edges(spark, sf_dir), _nations(spark, sf_dir), direction="in", types=["located_in"])


@query(f"WITH {EDGE_SQL} SELECT id, src, dst, type FROM v_edge WHERE src IN {_AT_NATIONS} OR dst IN {_AT_NATIONS}")
def edges_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(edges(spark, sf_dir), _nations(spark, sf_dir))


_LOOSE = "SELECT md5('s' || s_suppkey || '|x' || s_suppkey || '|supplies') AS id, 's' || s_suppkey AS src, 'x' || s_suppkey AS dst, 'supplies' AS type FROM supplier"


@query(f"WITH {ENTITY_SQL}, {EDGE_SQL}, e AS (SELECT * FROM v_edge UNION ALL {_LOOSE}) SELECT id, src, dst, type FROM e WHERE src NOT IN (SELECT id FROM v_entity) OR dst NOT IN (SELECT id FROM v_entity)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("x"), "s_suppkey").alias("dst"), F.lit("supplies").alias("type"))
    loose = loose.select(F.md5(F.concat_ws("|", "src", "dst", "type")).alias("id"), "src", "dst", "type")
    return graph.dangling(edges(spark, sf_dir).unionByName(loose), entities(spark, sf_dir))


_HOPS = """both_ways AS (SELECT src, dst FROM v_edge UNION SELECT dst, src FROM v_edge),
one AS (SELECT 'r' || r_regionkey AS origin, dst AS id FROM region JOIN both_ways ON src = 'r' || r_regionkey)"""


@query(f"WITH {EDGE_SQL}, {_HOPS} SELECT DISTINCT origin, id, 1 AS hops FROM one")
def neighbors_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.neighbors(edges(spark, sf_dir), regions, 1)


@query(f"""WITH {EDGE_SQL}, {_HOPS}, two AS (SELECT origin, dst AS id FROM one JOIN both_ways ON src = one.id)
SELECT origin, id, min(h) AS hops FROM (SELECT origin, id, 1 AS h FROM one UNION ALL SELECT origin, id, 2 FROM two) WHERE id <> origin GROUP BY ALL""")
def neighbors_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.neighbors(edges(spark, sf_dir), regions, 2)


@query("SELECT p_partkey AS alias, min(p_partkey) OVER w AS canonical FROM part WINDOW w AS (PARTITION BY p_name, p_brand) QUALIFY p_partkey > min(p_partkey) OVER w")
def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_aliases(aliases(spark, sf_dir))


@query(f"WITH {EDGE_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM v_edge UNION ALL SELECT dst FROM v_edge) GROUP BY id ORDER BY degree DESC, id LIMIT 25")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(25)


@query()
def community_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select(F.lit(TENANT).alias("tenant_id"), "src", "dst", F.lit(1.0).alias("weight"))
    return communities.communities(entities(spark, sf_dir), e).select("id", "community")


_VOCABULARY = {
    "domain_id": "trade", "display_name": "Trade", "entity_types": [{"id": t} for t in ("customer", "supplier", "part", "nation", "region")],
    "relationship_types": [{"id": "located_in", "valid_source_types": ["customer"], "valid_target_types": ["nation"]}, {"id": "part_of", "valid_target_types": ["region"]}],
}


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL} SELECT e.id, CASE WHEN type = 'supplies' THEN 'unknown_type' WHEN type = 'located_in' AND a.entity_type <> 'customer' THEN 'bad_source' END AS problem
FROM v_edge e JOIN v_entity a ON a.id = e.src""")
def type_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).select("id", "entity_type")
    typed = edges(spark, sf_dir).join(e.toDF("src", "source_type"), "src").join(e.toDF("dst", "target_type"), "dst")
    return domains.validate_edges(typed, domains.type_table(spark, domains.validate(_VOCABULARY))).select("id", "problem")


# --- resolution



def _soundex_sql(l: str) -> str:
    codes = "translate(upper({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')".format(l)
    run = f"left({codes}, 1) || replace(substr({codes}, 2), '7', '')"
    for d in "0123456":
        run = f"regexp_replace({run}, '{d}+', '{d}', 'g')"
    return f"upper(left({l}, 1)) || left(replace(substr({run}, 2), '0', '') || '000', 3)"


_LETTERS = "regexp_replace(name, '[^A-Za-z]', '', 'g')"
_NAMES_SQL = f"""{ENTITY_SQL}, {EDGE_SQL},
names AS (SELECT min(id) AS id, name, lower(name) AS nn, entity_type FROM v_entity WHERE entity_type <> 'customer' GROUP BY name, entity_type),
keys AS (SELECT id, 'p:' || substr(nn, 1, 5) AS key FROM names UNION SELECT id, 's:' || {_soundex_sql(_LETTERS)} FROM names WHERE {_LETTERS} <> '' UNION SELECT id, 't:' || entity_type FROM names)"""


def _named(spark: SparkSession, sf_dir: str, *, customers: bool = False) -> DataFrame:
    """Entities by name and type, with the default three blocking keys. Queries that list pairs leave customers out: their names are
    numbers, and the block of their type holds the square of their count."""
    named = entities(spark, sf_dir) if customers else entities(spark, sf_dir).filter("entity_type <> 'customer'")
    named = named.groupBy("tenant_id", "name", "entity_type").agg(F.min("id").alias("id"))
    return named.withColumn("blocking_keys", text.blocking_keys(F.col("name"), F.col("entity_type"), ascii_only=True))


@query(f"WITH {_NAMES_SQL} SELECT id, key FROM keys")
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.key_table(_named(spark, sf_dir)).select("id", "key")


@query(f"WITH {_NAMES_SQL} SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y USING (key) WHERE x.id < y.id")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.blocked_pairs(_named(spark, sf_dir)).select("a", "b")


_OVERLAP = "len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / least(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' '))))"
_SIMILAR = "greatest(jaro_winkler_similarity({0}, {1}), 0.85 * " + _OVERLAP + ")"
_PAIRS_SQL = f"pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y USING (key) WHERE x.id < y.id)"


@query(f"WITH {_NAMES_SQL}, {_PAIRS_SQL} SELECT a, b, round({_SIMILAR.format('x.nn', 'y.nn')}, 6) AS name FROM pairs JOIN names x ON x.id = a JOIN names y ON y.id = b")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.compared_pairs(_named(spark, sf_dir), ("name",)).select("a", "b", r6(F.col("name")).alias("name"))


def _part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector n is that of part n."""
    return table(spark, sf_dir, "embeddings").select(F.lit(TENANT).alias("tenant_id"), F.concat(F.lit("p"), "vec_id").alias("id"), "embedding")


_PAIR_COSINE = "least(1, greatest(0, (1 + list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)))) / 2))"
_NEAR_SQL = f"""vec AS (SELECT 'p' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a, b, emb FROM (SELECT x.id AS a, y.id AS b, {_PAIR_COSINE} AS emb FROM vec x, vec y WHERE x.id IN (SELECT a FROM pairs)) QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(emb, 12) DESC, b) <= 50)"""


@query(f"WITH pairs AS (SELECT DISTINCT 'p' || vec_id AS a FROM embeddings WHERE vec_id % 20 = 0), {_NEAR_SQL} SELECT a, b, round(emb, 6) AS embedding FROM near")
def nearest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest of every twentieth vector among all."""
    v = _part_vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.lit(TENANT).alias("tenant_id"), F.concat(F.lit("p"), "vec_id").alias("a"))
    return resolve.nearest(asked, v).select("a", "b", r6(F.col("embedding")).alias("embedding"))


_BANDS_SQL = f"""WITH {_NAMES_SQL}, {_PAIRS_SQL}, {_NEAR_SQL},
lists AS (SELECT e.id, list(DISTINCT lower(v.name)) AS names FROM (SELECT src AS id, dst AS o FROM v_edge UNION ALL SELECT dst, src FROM v_edge) e JOIN v_entity v ON v.id = e.o WHERE e.id IN (SELECT id FROM names) GROUP BY e.id),
f AS (SELECT pairs.a, pairs.b, {_SIMILAR.format('x.nn', 'y.nn')} AS name, emb, CASE WHEN p.names IS NULL AND q.names IS NULL THEN NULL WHEN p.names IS NULL OR q.names IS NULL THEN 0
  ELSE len(list_intersect(p.names, q.names)) / len(list_distinct(list_concat(p.names, q.names))) END AS graph
  FROM pairs JOIN names x ON x.id = a JOIN names y ON y.id = b LEFT JOIN lists p ON p.id = a LEFT JOIN lists q ON q.id = b LEFT JOIN near n ON n.a = pairs.a AND n.b = pairs.b),
s AS (SELECT *, (0.5 * name + coalesce(0.2 * graph, 0) + coalesce(0.3 * emb, 0)) / (0.5 + CASE WHEN graph IS NULL THEN 0 ELSE 0.2 END + CASE WHEN emb IS NULL THEN 0 ELSE 0.3 END) AS score FROM f)"""


def _evidence(spark: SparkSession, sf_dir: str, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names around these entities, and the vectors nearest to those of the parts among them."""
    around = graph.neighbour_names(edges(spark, sf_dir), entities(spark, sf_dir).select("id", text.normalize_name(F.col("name")).alias("normalized_name"))).join(named.select("id"), "id", "left_semi")
    near = resolve.nearest(named.filter("entity_type = 'part'").select("tenant_id", F.col("id").alias("a")), _part_vectors(spark, sf_dir))
    return around, near


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = materialise(_named(spark, sf_dir), "named")
    return resolve.scored(resolve.compared_pairs(named, ("name", "embedding", "graph"), *_evidence(spark, sf_dir, named)))


@query(_BANDS_SQL + " SELECT a, b, round(emb, 6) AS embedding, round(graph, 6) AS graph, round(score, 6) AS score, CASE WHEN score >= 0.92 THEN 'merge' WHEN score >= 0.75 THEN 'adjudicate' ELSE 'reject' END AS decision FROM s")
def combined_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).select("a", "b", *[r6(F.col(c)).alias(c) for c in ("embedding", "graph", "score")], "decision")


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL}, n AS (SELECT e.id, list(DISTINCT lower(v.name)) AS names FROM (SELECT src AS id, dst AS o FROM v_edge UNION ALL SELECT dst, src FROM v_edge) e JOIN v_entity v ON v.id = e.o WHERE e.id LIKE 'n%' OR e.id LIKE 's%' GROUP BY e.id)
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.names, y.names)) / len(list_distinct(list_concat(x.names, y.names))), 6) AS jaccard FROM n x JOIN n y ON x.id[1] = y.id[1] AND x.id < y.id""")
def neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and suppliers, by the names of all entities around them; pairs are those of one type's block."""
    named = entities(spark, sf_dir)
    around = graph.neighbour_names(edges(spark, sf_dir), named.select("id", text.normalize_name(F.col("name")).alias("normalized_name")))
    asked = named.filter(F.col("entity_type").isin("nation", "supplier")).withColumn("blocking_keys", F.array("entity_type"))
    around = materialise(around.join(asked.select("id"), "id", "left_semi"), "names-around")
    pairs = resolve.compared_pairs(asked.join(around.select("id"), "id", "left_semi"), ("graph",), around)
    return pairs.select("a", "b", r6(F.col("graph")).alias("jaccard"))


@query(f"""WITH {_NAMES_SQL}, q AS (SELECT '{PART_QUERY}' AS name), qk AS (SELECT 'p:' || substr(name, 1, 5) AS key FROM q UNION SELECT 's:' || {_soundex_sql(_LETTERS)} FROM q)
SELECT id, round({_SIMILAR.format("nn", "'" + PART_QUERY + "'")}, 6) AS score FROM names WHERE id IN (SELECT id FROM keys WHERE key IN (SELECT key FROM qk)) ORDER BY 2 DESC, id LIMIT 10""")
def lexical_entity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_entities(_named(spark, sf_dir), PART_QUERY, 10).select("id", r6(F.col("score")).alias("score"))


def _judge(least: float):
    """The stand-in of a model: says yes from a score on."""

    def judge(pairs: list[tuple]) -> list[bool | None]:
        return [p[3] >= least for p in pairs]

    return judge


_ALL_BANDS_SQL = _BANDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(" WHERE entity_type <> 'customer' GROUP BY name", " GROUP BY name")


@query(_ALL_BANDS_SQL + f", confirmed AS (SELECT a, b, round(score, 9) AS score FROM s WHERE score >= 0.85), {recursive_sql.fold('confirmed')} SELECT canonical, absorbed, round(score, 6) AS score FROM folded")
def consolidation_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure pairs, and those between the bands that the judge confirms, in one ordered pass over every entity."""
    named = materialise(_named(spark, sf_dir, customers=True), "named")

    def confirm(banded: DataFrame) -> DataFrame:
        rounded = materialise(banded.filter("decision <> 'reject'").select("tenant_id", "a", "b", F.round("score", 9).alias("score"), "decision"), "bands")
        judged = resolve.adjudicate(rounded.filter("decision = 'adjudicate'"), _judge(0.85)).filter("verdict")
        return rounded.filter("decision = 'merge'").unionByName(judged.drop("verdict")).drop("decision")

    return resolve.consolidate(named, confirm, *_evidence(spark, sf_dir, named)).select("canonical", "absorbed", r6(F.col("score")).alias("score"))


@query(_BANDS_SQL + """, c AS (SELECT CASE WHEN a = 's0' THEN b ELSE a END AS absorbed, score FROM s WHERE (a = 's0' OR b = 's0') AND a <> 's3' AND b <> 's3' AND score >= 0.8)
SELECT 's0' AS canonical, absorbed, round(score, 6) AS score FROM c""")
def resolve_one_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject that is an alias of an alias; of what it could be merged with one is an alias already."""
    named = _named(spark, sf_dir)
    around = graph.neighbour_names(edges(spark, sf_dir), entities(spark, sf_dir).select("id", text.normalize_name(F.col("name")).alias("normalized_name")))
    known = spark.createDataFrame([("oldest", "old"), ("old", "s0"), ("s3", "s0")], "alias string, canonical string")
    return resolve.resolve_subject("oldest", named, known, _judge(0.8), names=around).select("canonical", "absorbed", r6(F.col("score")).alias("score"))


@query("""WITH p AS (SELECT p_partkey - 1 AS i, p_partkey, p_name, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS nth FROM part)
SELECT nth // 10 AS batch, string_agg((nth % 10 + 1) || '. ' || p_name || ' (part) | ' || p_brand || ' (brand)', chr(10) ORDER BY nth) AS prompt FROM p GROUP BY 1""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pairs for the judge, ten at a time."""
    rows = placed(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    pairs = rows.select(F.lit(TENANT).alias("tenant_id"), (F.col("place") - 1).alias("nth"), F.col("p_name").alias("a_name"), F.lit("part").alias("a_type"), F.col("p_brand").alias("b_name"), F.lit("brand").alias("b_type"))
    return resolve.question(pairs).select("batch", "prompt")


@query("""WITH n AS (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS before, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part)
SELECT p_partkey + 1 AS absorbed, CASE WHEN before IS NULL THEN p_partkey ELSE first END AS canonical FROM n WHERE CASE WHEN before IS NULL THEN p_partkey ELSE first END <> p_partkey + 1""")
def merges_through_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges into ids that were absorbed meanwhile go to where those went."""
    merges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("canonical"), (F.col("p_partkey") + 1).alias("absorbed"))
    return resolve.retry_through_aliases(merges, aliases(spark, sf_dir)).select("absorbed", "canonical")


_MERGED = "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part"


@query(f"""WITH {EDGE_SQL}, m AS (SELECT 'p' || p_partkey AS absorbed, 'p' || c AS canonical FROM ({_MERGED}) WHERE p_partkey <> c),
g AS (SELECT absorbed AS m, canonical AS t FROM m UNION SELECT canonical, canonical FROM m),
x AS (SELECT e.*, coalesce(a.t, src) AS s, coalesce(b.t, dst) AS d FROM v_edge e LEFT JOIN g a ON a.m = src LEFT JOIN g b ON b.m = dst WHERE a.m IS NOT NULL OR b.m IS NOT NULL),
w AS (SELECT *, s <> d AND row_number() OVER (PARTITION BY s, d, type ORDER BY id DESC) = 1 AS stays FROM x)
SELECT id, src AS before_src, dst AS before_dst, type, CASE WHEN stays THEN s END AS after_src, CASE WHEN stays THEN d END AS after_dst FROM w WHERE NOT (stays AND s = src AND d = dst)""")
def redirect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir).select(F.col("name").alias("p_name"), F.col("id").alias("c"))
    merged = table(spark, sf_dir, "part").join(names, "p_name").filter("p_partkey <> c").select(F.concat(F.lit("p"), "p_partkey").alias("absorbed"), F.concat(F.lit("p"), "c").alias("canonical"))
    return merge.plan_redirections(edges(spark, sf_dir), merged)


# --- versions and claims


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def lww_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_write(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, length(props) DESC, props DESC, event_id) = 1")
def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "props")
    return merge.best_version(versions, ["user_id", "event_type"], F.struct("value", F.length("props").alias("size"), "props"), "event_id")


@query("""WITH c AS (SELECT user_id, 'properties.' || event_type AS path, event_id, props, ts, value FROM events), k AS (
SELECT user_id, path, list(props ORDER BY event_id) AS c, arg_max(props, {'t': ts, 'v': value, 'i': event_id}) AS latest FROM c GROUP BY ALL)
SELECT user_id AS group_id, path, CASE path WHEN 'properties.error' THEN array_to_string(list_transform(list_sort(list_distinct(list_transform(c, lambda x: [list_position(c, x)::VARCHAR.lpad(9, '0'), x]))), lambda y: y[2]), '|')
  WHEN 'properties.click' THEN c[least(2, len(c))] WHEN 'properties.view' THEN latest ELSE c[1] END AS value FROM k""")
def property_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("group_id"), F.concat(F.lit("properties."), "event_type").alias("path"), F.col("event_id").alias("ordinal"), F.array("props").alias("value"),
        F.col("ts").alias("observed_at"), F.col("value").alias("confidence"), F.col("event_id").alias("origin"),
    )
    overrides = {"properties.error": "union", "properties.click": "prefer_merged", "properties.view": "most_recently_observed"}
    return merge.resolve(claims, ["group_id", "path"], overrides=overrides).select("group_id", "path", F.array_join("values", "|").alias("value"))


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND l.doc_id IS NOT NULL")
def replace_source_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the old version that a new one (the English documents) lacks."""
    return store.orphans(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"])


# --- time


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in time, the customer their tenant: status gives the precision, priority the uncertainty."""
    precision = F.when(F.col("o_orderstatus") == "F", "day").when(F.col("o_orderstatus") == "O", "month").otherwise("year")
    marker = F.when(F.col("o_orderpriority").startswith("1"), "before").when(F.col("o_orderpriority").startswith("2"), "after").otherwise("exact")
    date = F.col("o_orderdate").cast("timestamp")
    bounds = temporal.bounds(date, F.lit(None).cast("timestamp"), precision, marker)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("id"), bounds.alias("bounds"))


_BOUNDS_SQL = """
o AS (SELECT o_custkey AS tenant_id, o_orderkey AS id, o_orderdate::TIMESTAMP AS s, left(o_orderpriority, 1) AS u,
  CASE o_orderstatus WHEN 'F' THEN date_trunc('day', o_orderdate::TIMESTAMP) + INTERVAL 1 DAY WHEN 'O' THEN date_trunc('month', o_orderdate::TIMESTAMP) + INTERVAL 1 MONTH ELSE date_trunc('year', o_orderdate::TIMESTAMP) + INTERVAL 1 YEAR END AS w FROM orders),
b AS (SELECT tenant_id, id, CASE u WHEN '1' THEN NULL WHEN '2' THEN w ELSE s END AS lo, CASE u WHEN '1' THEN s WHEN '2' THEN NULL ELSE w END AS up FROM o)"""
_RELATE = """CASE WHEN {0}.lo IS NOT DISTINCT FROM {1}.lo AND {0}.up IS NOT DISTINCT FROM {1}.up THEN 'equals'
  WHEN coalesce({0}.up <= {1}.lo, false) THEN 'before' WHEN coalesce({1}.up <= {0}.lo, false) THEN 'after'
  WHEN ({1}.lo IS NULL OR coalesce({1}.lo <= {0}.lo, false)) AND ({1}.up IS NULL OR coalesce({0}.up <= {1}.up, false)) THEN 'during'
  WHEN ({0}.lo IS NULL OR coalesce({0}.lo <= {1}.lo, false)) AND ({0}.up IS NULL OR coalesce({1}.up <= {0}.up, false)) THEN 'contains' ELSE 'overlaps' END"""


@query(f"WITH {_BOUNDS_SQL} SELECT id, strftime(lo, {STAMP}) AS lower, strftime(up, {STAMP}) AS upper FROM b")
def temporal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extents(spark, sf_dir).select("id", stamp(F.col("bounds.lower")).alias("lower"), stamp(F.col("bounds.upper")).alias("upper"))


@query(f"""WITH {_BOUNDS_SQL}, q AS (SELECT TIMESTAMP '1997-03-01' AS lo, TIMESTAMP '1998-01-01' AS up),
r AS (SELECT b.id, {_RELATE.format('b', 'q')} AS relation FROM b, q) SELECT id, relation FROM r WHERE relation NOT IN ('before', 'after')""")
def entities_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = intervals.interval(F.lit("1997-03-01 00:00:00"), F.lit("1998-01-01 00:00:00"))
    return intervals.in_interval(_extents(spark, sf_dir), asked).select("id", "relation")


@query(f"WITH {_BOUNDS_SQL} SELECT id, row_number() OVER (ORDER BY lo NULLS FIRST, up NULLS LAST, id) AS place FROM b")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_extents(spark, sf_dir).filter("bounds is not null"), *intervals.time_order()).select("id", "place")


@query(f"""WITH {_BOUNDS_SQL}, r AS (SELECT x.tenant_id, x.id AS a, y.id AS b, {_RELATE.format('x', 'y')} AS r FROM b x JOIN b y ON x.tenant_id = y.tenant_id AND x.id < y.id)
SELECT tenant_id, CASE WHEN r IN ('after', 'during') THEN b ELSE a END AS first, CASE WHEN r IN ('after', 'during') THEN a ELSE b END AS second, CASE r WHEN 'after' THEN 'before' WHEN 'during' THEN 'contains' ELSE r END AS relation FROM r""")
def temporal_relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.relation_pairs(_extents(spark, sf_dir), max_pairs=None)


@query(f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders),
p AS (SELECT *, CASE k WHEN 1 THEN make_timestamp(y, q * 3 - 2, 1, 0, 0, 0) WHEN 3 THEN make_timestamp(y // 10 * 10, 1, 1, 0, 0, 0) WHEN 4 THEN make_timestamp(1934, 1, 1, 0, 0, 0) ELSE make_timestamp(y, 1, 1, 0, 0, 0) END AS s,
  CASE k WHEN 2 THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) WHEN 3 THEN make_timestamp(y // 10 * 10 + 9, 1, 1, 0, 0, 0) WHEN 4 THEN make_timestamp(1966, 1, 1, 0, 0, 0) END AS e FROM t)
SELECT id, strftime(s, {STAMP}) AS "start", strftime(e, {STAMP}) AS "end", CASE k WHEN 1 THEN 'month' ELSE 'year' END AS "precision",
  CASE k WHEN 0 THEN 'circa' WHEN 3 THEN 'before' WHEN 4 THEN 'approximate' ELSE 'exact' END AS uncertainty FROM p""")
def parse_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate").cast("string")
    kinds = [F.concat(F.lit("circa "), y), F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), y), F.concat(y, F.lit("-"), F.year("o_orderdate") + 1), F.concat(F.lit("before the "), F.substring(y, 1, 3), F.lit("0s")), F.lit("mid 20th century")]
    written = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 5 + 1).cast("int"))
    e = temporal.parse(written, calendar=False)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), e.alias("e")).select("id", stamp(F.col("e.start_date")).alias("start"), stamp(F.col("e.end_date")).alias("end"), "e.precision", "e.uncertainty")


# --- structured data


@query("""SELECT type, name, external_ids FROM (SELECT 'person' AS type, c_name AS name, '{"schema_org_id": "c' || c_custkey || '"}' AS external_ids FROM customer
UNION ALL SELECT 'location', n_name, '{}' FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def jsonld_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.struct(F.lit("Country").alias("@type"), F.col("n_name").alias("name"))
    item = F.to_json(F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("c"), "c_custkey").alias("@id"), F.col("c_name").alias("name"), place.alias("address")))
    return c.select(F.inline(structured.json_ld(item))).select("type", "name", "external_ids")


@query("""SELECT 'product' AS type, p_name AS name, p_brand AS description, '{"price_amount":"' || p_size || '"}' AS properties FROM part""")
def open_graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    og = F.create_map(F.lit("type"), F.lit("product"), F.lit("title"), F.col("p_name"), F.lit("description"), F.col("p_brand"), F.lit("product:price:amount"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(structured.open_graph(og).alias("e")).select("e.type", "e.name", "e.description", "e.properties")


@query("""SELECT page_id, 'person' AS type, 'Author ' || page_id AS name, 'schema_org' AS method FROM pages
UNION ALL SELECT page_id, 'organization', 'Press ' || page_id % 7, 'schema_org' FROM pages
UNION ALL SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'product' ELSE 'person' END, 'Page > ' || page_id, 'open_graph' FROM pages WHERE page_id % 4 <> 0""")
def page_structured_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page states an author with an organization; three of four state a title too, their attributes in either order."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    item = F.to_json(F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("Author "), n).alias("name"), F.struct(F.lit("Organization").alias("@type"), F.concat(F.lit("Press "), (F.col("page_id") % 7).cast("string")).alias("name")).alias("worksFor")))
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<META content='Page > "), n, F.lit("' property=og:title />"))).otherwise(F.concat(F.lit('<meta property="og:title" content="Page > '), n, F.lit('">')))
    kind = F.concat(F.lit('<meta class="x" name="og:type" content="'), F.element_at(F.array(F.lit("article"), F.lit("book"), F.lit("profile")), (F.col("page_id") % 3 + 1).cast("int")), F.lit('">'))
    stated = F.concat(F.lit('<script type="application/ld+json">'), item, F.lit("</script>"), F.when(F.col("page_id") % 4 != 0, F.concat(title, kind)).otherwise(F.lit('<meta name="viewport" content="og:title">')))
    return structured.page_entities(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), stated))).select("page_id", "type", "name", "method")


# --- evaluation, limits, log


@query("""WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), a AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500)
SELECT (SELECT count(*) FROM e JOIN a USING (doc_id)) AS tp, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS fp, (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS fn""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels").filter("quality = 1"), table(spark, sf_dir, "documents").filter("n_chars > 500"), ["doc_id"])


@query("""WITH n AS (SELECT p_name AS name FROM part UNION SELECT p_name || ' ' || p_type FROM part), w AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS words FROM n)
SELECT a.name AS shorter, b.name AS longer FROM w a JOIN w b ON len(a.words) < len(b.words) AND list_has_all(b.words, a.words)""")
def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return evaluate.variant_pairs(part.select(F.col("p_name").alias("name")).unionByName(part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"))))


@query("""WITH r AS (SELECT DISTINCT ts::DATE AS run, user_id || event_type AS key FROM events), k AS (SELECT key, count(*) AS n FROM r GROUP BY key)
SELECT count(*) FILTER (WHERE n = (SELECT count(DISTINCT run) FROM r)) AS common, count(*) AS "all", round(count(*) FILTER (WHERE n = (SELECT count(DISTINCT run) FROM r)) / count(*), 6) AS jaccard FROM k""")
def stability_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.to_date("ts").alias("run"), F.concat("user_id", "event_type").alias("key"))
    return evaluate.stability(runs).select("common", "all", r6(F.col("jaccard")).alias("jaccard"))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events)
SELECT min(value) FILTER (WHERE rn >= 0.5 * n) AS p50, min(value) FILTER (WHERE rn >= 0.95 * n) AS p95, max(value) AS max FROM v""")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gaps(table(spark, sf_dir, "events"), "value")


@query(f"""SELECT event_id, count(*) OVER w AS hits, strftime(min(ts) OVER w, {STAMP}) AS oldest, greatest(0, 3 - count(*) OVER w) AS remaining
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "ts", "event_id")
    return limits.trailing_hits(hits, 3600, 3).select("event_id", "hits", stamp(F.col("oldest")).alias("oldest"), "remaining")


@query(recursive_sql.RATE_ADMISSIONS)
def rate_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.admissions(table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "ts", "event_id"), 3, 86_400)


@query(recursive_sql.CIRCUIT_BREAKER)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.breaker_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")), 2, 3600)
