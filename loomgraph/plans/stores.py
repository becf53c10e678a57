"""Queries that write stores in the shared folder, change them, and return what they hold or find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as names
from loomgraph.operators import resolve
from loomgraph.plans.queries import TERMS, VECTOR, _COSINE, _TERM_LIST, _TOKENS
from loomgraph.plans.registry import query, r6
from loomgraph.sources import store
from loomgraph.sources.shared import fresh_path
from loomgraph.sources.tables import EDGE_SQL, ENTITY_SQL, TENANT, aliases, edges, entities, table

_EVENT = "tenant_id string, id string, event_id long, value double"


def _events(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """One tenant for each event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("tenant_id"), F.col(key).cast("string").alias("id"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


@query("""WITH e AS (SELECT event_type AS tenant_id, CAST(user_id AS VARCHAR) AS id, event_id, value FROM events)
SELECT tenant_id, id, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY tenant_id, id ORDER BY event_id % 2 DESC, event_id DESC) = 1""")
def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events, then odd ones over them: the last write of each key stays."""
    kept = store.KeyedTable(spark, fresh_path(spark, "upserts"), _EVENT)
    rows = _events(spark, sf_dir)
    for odd in (0, 1):
        kept.upsert(rows.filter(F.col("event_id") % 2 == odd), "event_id")
    return kept.read()


@query("""SELECT event_type AS tenant_id, CAST(event_id AS VARCHAR) AS id, event_id, value FROM events
WHERE event_type <> 'error' AND event_id % 7 <> 0 AND NOT (event_type = 'click' AND value > 50)""")
def store_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh key goes, then a tenant, then a tenant's rows above a value."""
    kept = store.KeyedTable(spark, fresh_path(spark, "deletes"), _EVENT)
    rows = _events(spark, sf_dir, "event_id")
    kept.upsert(rows)
    kept.delete(rows.filter("event_id % 7 = 0"))
    kept.delete_where("error")
    kept.delete(kept.get("click").filter("value > 50"))
    kept.vacuum()
    return kept.read()


@query("""WITH k AS (SELECT event_type, event_id, user_id, event_id % 7 = 0 AS seventh FROM events)
SELECT 'keys' AS what, count(*) AS n FROM k WHERE seventh UNION ALL SELECT 'again', 0
UNION ALL SELECT 'event', count(*) FROM k WHERE NOT seventh AND event_type = 'view' AND event_id = 11
UNION ALL SELECT 'tenant', count(*) FROM k WHERE NOT seventh AND event_type = 'error' UNION ALL SELECT 'no tenant', 0""")
def store_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delete says it removed; a key or tenant that isn't there counts none."""
    kept = store.KeyedTable(spark, fresh_path(spark, "counts"), _EVENT)
    rows = _events(spark, sf_dir, "event_id")
    kept.upsert(rows)
    sevenths = rows.filter("event_id % 7 = 0")
    said = [("keys", kept.delete(sevenths)), ("again", kept.delete(sevenths)), ("event", kept.delete_where("view", id="11")), ("tenant", kept.delete_where("error")), ("no tenant", kept.delete_where("nobody"))]
    return spark.createDataFrame(said, "what string, n long")


def _graph(spark: SparkSession, sf_dir: str) -> store.GraphStore:
    held = store.GraphStore(spark, fresh_path(spark, "graph"))
    known = entities(spark, sf_dir)
    held.entities.upsert(known.withColumn("blocking_keys", names.blocking_keys(F.col("name"), F.col("entity_type"), ascii_only=True)))
    held.upsert_relationships(edges(spark, sf_dir).withColumn("tenant_id", F.lit(TENANT)))
    chained = aliases(spark, sf_dir).select(F.lit(TENANT).alias("tenant_id"), F.concat(F.lit("p"), "alias").alias("alias"), F.concat(F.lit("p"), "canonical").alias("canonical"))
    held.aliases.upsert(chained)
    return held


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL}
SELECT 'entity' AS kind, id FROM v_entity WHERE id = 'n7' UNION ALL SELECT 'both', id FROM v_edge WHERE src = 'n7' OR dst = 'n7'
UNION ALL SELECT 'out', id FROM v_edge WHERE src = 'n7' UNION ALL SELECT 'in', id FROM v_edge WHERE dst = 'n7' AND type = 'located_in'""")
def graph_store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity by id, and the edges at it in each direction; an id or tenant that isn't there gives nothing."""
    held = _graph(spark, sf_dir)
    found = held.entities.get(TENANT, id="n7").unionByName(held.entities.get(TENANT, id="n999")).unionByName(held.entities.get("other", id="n7")).select(F.lit("entity").alias("kind"), "id")
    for kind, types in (("both", None), ("out", None), ("in", ["located_in"])):
        found = found.unionByName(held.relationships(TENANT, "n7", direction=kind, types=types).select(F.lit(kind).alias("kind"), "id"))
    return found


@query("""WITH n AS (SELECT 'p' || p_partkey AS alias, 'p' || lag(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS canonical FROM part),
c AS (SELECT canonical FROM n WHERE canonical IS NOT NULL ORDER BY 1 LIMIT 1)
SELECT alias, canonical, row_number() OVER (ORDER BY alias) AS place FROM n WHERE canonical = (SELECT canonical FROM c)""")
def direct_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases of the first canonical id, not those of its aliases."""
    held = _graph(spark, sf_dir)
    first = held.aliases.read(TENANT).agg(F.min("canonical")).first()[0]
    found = held.find_aliases(TENANT, first or "").select("alias", "canonical")
    return found.withColumn("place", F.row_number().over(_by("alias")).cast("long"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*columns)  # of one source or entity, not of a table


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL} SELECT 'entities' AS what, count(*) AS n FROM v_entity UNION ALL SELECT 'left', 0
UNION ALL SELECT 'refused', count(*) FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier) UNION ALL SELECT 'edges', count(*) FROM v_edge""")
def graph_store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge into nowhere is refused with all its batch; a purge counts entities and takes edges and aliases along."""
    held = _graph(spark, sf_dir)
    loose = spark.createDataFrame([(TENANT, "loose", "n1", "nowhere", "part_of"), (TENANT, "fine", "n1", "n2", "part_of")], store.GraphStore.EDGE)
    refused = 0
    try:
        held.upsert_relationships(loose)
    except LookupError:
        refused = 1
    before = held.edges.read().count()
    gone = held.delete_by_tenant(TENANT)
    left = sum(t.read().count() for t in (held.entities, held.edges, held.aliases))
    return spark.createDataFrame([("entities", gone), ("left", left), ("refused", refused), ("edges", before)], "what string, n long")


_KEYS_SQL = "keys AS (SELECT id, 'p:' || substr(regexp_replace(lower(name), '\\s+', ' ', 'g'), 1, 5) AS key FROM v_entity UNION SELECT id, 't:' || entity_type FROM v_entity)"


@query(f"""WITH {ENTITY_SQL}, {_KEYS_SQL}, q AS (SELECT * FROM (VALUES ('p:small'), ('t:region'), ('p:zzzzz')) v(key))
SELECT key, coalesce(list(id ORDER BY id) FILTER (WHERE id IS NOT NULL), []) AS ids FROM q LEFT JOIN keys USING (key) GROUP BY key""")
def blocking_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by blocking key, from the store; a key that nothing has comes with an empty list."""
    asked = spark.createDataFrame([("p:small",), ("t:region",), ("p:zzzzz",)], "key string")
    return resolve.find_by_keys(asked, _graph(spark, sf_dir).entities.read(TENANT))


# --- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("string").alias("tenant_id"), F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label_"), "label").alias("entity_type"), F.col("embedding").cast("array<float>").alias("embedding"))


@query(f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding FROM embeddings WHERE label % 2 = 1 AND vec_id % 5 <> 0)
SELECT id, round({_COSINE}, 6) AS score FROM v WHERE {_COSINE} >= 0.5 ORDER BY {_COSINE} DESC, id LIMIT 25""")
def vector_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, every fifth deleted, searched in one tenant; a batch with a bad row is refused whole."""
    held = store.VectorStore(spark, fresh_path(spark, "vectors"), 64)
    rows = _vectors(spark, sf_dir)
    held.upsert_many(rows)
    try:
        held.upsert_many(rows.withColumn("embedding", F.when(F.col("id") == F.lit("1"), F.array_repeat(F.lit(0).cast("float"), 64)).otherwise(F.col("embedding"))))
    except ValueError:
        pass
    held.delete(rows.filter("cast(id as long) % 5 = 0"))
    return held.search("1", VECTOR, 25, min_score=0.5).select("id", r6(F.col("score")).alias("score"))


@query("SELECT vec_id AS id, CASE vec_id % 4 WHEN 1 THEN 'width' ELSE 'zero_norm' END AS problem FROM embeddings WHERE vec_id % 4 IN (1, 2)")
def vector_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the vectors too short, a quarter zero, a quarter absent, which is none."""
    kind = F.col("vec_id") % 4
    bad = F.when(kind == 1, F.slice("embedding", 1, 63)).when(kind == 2, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).when(kind == 0, F.col("embedding"))
    return store.vector_problems(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bad.cast("array<float>").alias("embedding")), 64)


# --- passages


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage for each line of every document; its entities are the document's language and source."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    own = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.lpad(F.col("chunk_index").cast("string"), 5, "0"))
    return lines.select(F.lit(TENANT).alias("tenant_id"), own.alias("id"), F.col("doc_id").cast("string").alias("source_id"), "chunk_index", F.col("line").alias("text"), F.array("lang", "source").alias("entity_ids"), F.lit(None).cast("array<float>").alias("embedding"))


_LINES_SQL = """lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id || '#' || lpad(CAST(i AS VARCHAR), 5, '0') AS id, CAST(doc_id AS VARCHAR) AS source_id, i AS chunk_index, text, lang, source FROM lines)"""


def _store(spark: SparkSession, sf_dir: str) -> store.PassageStore:
    held = store.PassageStore(spark, fresh_path(spark, "passages"))
    held.upsert_many(_passages(spark, sf_dir))
    return held


@query(f"""WITH {_LINES_SQL}, longest AS (SELECT source_id FROM p GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)
SELECT id, chunk_index, row_number() OVER (ORDER BY chunk_index, id) AS place FROM p WHERE source_id = (SELECT source_id FROM longest)""")
def passages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir)
    longest = held.read(TENANT).groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()[0]
    return held.by_source(TENANT, longest).select("id", "chunk_index", F.row_number().over(_by("chunk_index", "id")).cast("long").alias("place"))


@query(f"WITH {_LINES_SQL} SELECT id, source_id, chunk_index FROM p WHERE lang = 'de' OR source = 'de'")
def passages_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).by_entity(TENANT, "de").select("id", "source_id", "chunk_index")


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[store.PassageStore, int]:
    """The first source loses its passages after the first and the rest of it is rewritten."""
    held = _store(spark, sf_dir)
    first = held.read(TENANT).agg(F.min("source_id")).first()[0]
    fresh = held.get(TENANT, source_id=first).filter("chunk_index = 0").withColumn("text", F.lit("erble nicht erble"))
    return held, held.replace_source(TENANT, first, fresh)


_REPLACED_SQL = f"{_LINES_SQL}, f AS (SELECT min(source_id) AS s FROM p), r AS (SELECT id, source_id, CASE WHEN source_id = s THEN 'erble nicht erble' ELSE text END AS text FROM p, f WHERE source_id <> s OR chunk_index = 0)"


@query(f"WITH {_REPLACED_SQL} SELECT 'orphans' AS what, (SELECT count(*) FROM p) - (SELECT count(*) FROM r) AS n UNION ALL SELECT 'rows', count(*) FROM r UNION ALL SELECT 'foreign', 1")
def passages_replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many old passages a new version of a source lacks; a batch with a row of another source is refused."""
    held, lost = _replaced(spark, sf_dir)
    refused = 0
    try:
        held.replace_source(TENANT, "no such source", held.read(TENANT).limit(1))
    except ValueError:
        refused = 1
    return spark.createDataFrame([("orphans", lost), ("rows", held.read().count()), ("foreign", refused)], "what string, n long")


@query(f"WITH {_REPLACED_SQL} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS term FROM r) GROUP BY ALL")
def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written index after a replacement, made anew."""
    held, _ = _replaced(spark, sf_dir)
    held.backfill()
    return held.terms.read(TENANT).select("id", "term", "tf")


_STORED_BM25 = f"""{_REPLACED_SQL}, d AS (SELECT id, {_TOKENS} AS words FROM r), s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d),
q AS (SELECT * FROM (VALUES {_TERM_LIST}) v(term)), tf AS (SELECT id, len(words) AS dl, term, len(list_filter(words, lambda w: w = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
cut AS (SELECT id FROM tf WHERE tf > 0 GROUP BY id ORDER BY count(*) DESC, id LIMIT 200),
scored AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 AND id IN (SELECT id FROM cut) GROUP BY id)"""


@query(f"WITH {_STORED_BM25} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20")
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the 200 passages with the most asked terms, by the written index."""
    held, _ = _replaced(spark, sf_dir)
    return held.rank(TENANT, TERMS, 20, candidates=200).select("id", r6(F.col("score")).alias("score"))


@query(f"""WITH {_LINES_SQL}, c AS (SELECT id, lang, source, {_TOKENS} AS words FROM p)
SELECT 'entity' AS kind, CAST(count(*) AS BIGINT) AS n FROM p WHERE id = (SELECT min(id) FROM p) UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE vec_id = 3 AND label % 2 = (SELECT label % 2 FROM embeddings WHERE vec_id = 3)
UNION ALL SELECT 'lengths', sum(len(words)) FROM c""")
def store_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage and a vector by id, and the stored lengths."""
    held = _store(spark, sf_dir)
    first = held.read(TENANT).agg(F.min("id")).first()[0]
    vectors = store.VectorStore(spark, fresh_path(spark, "vectors"), 64)
    rows = _vectors(spark, sf_dir)
    vectors.upsert_many(rows)
    tenant = rows.filter("id = '3'").first()["tenant_id"]
    n = [("entity", held.get(TENANT, id=first).count()), ("vector", vectors.get(tenant, id="3").count()), ("lengths", int(held.lengths.read().agg(F.sum("doc_length")).first()[0] or 0))]
    return spark.createDataFrame(n, "kind string, n long")


@query(f"""WITH {_LINES_SQL}, t AS (SELECT source_id, chunk_index, sha256(encode(source_id) || '\\x00'::BLOB || encode(text)) AS id, lang FROM p)
SELECT source_id, id, min(chunk_index) AS chunk_index, list(DISTINCT lang || chunk_index % 2 ORDER BY lang || chunk_index % 2) AS entity_ids FROM t GROUP BY source_id, id""")
def stored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines of a document are one passage with the links of all."""
    from loomgraph.functions.ids import chunk_id
    from loomgraph.operators import chunkers

    rows = _passages(spark, sf_dir)
    pieces = rows.select("tenant_id", "source_id", "chunk_index", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "text").withColumn("id", chunk_id(F.col("source_id"), F.col("text")))
    links = rows.select("source_id", "chunk_index", F.concat(F.col("entity_ids")[0], F.col("chunk_index") % 2).alias("entity_id"))
    return chunkers.stored_chunks(pieces, links).select("source_id", "id", "chunk_index", "entity_ids")


@query("""WITH d AS (SELECT doc_id, text, lang FROM documents), g AS (SELECT doc_id, 'good' AS kind FROM d WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND doc_id % 3 <> 0)
SELECT * FROM g UNION ALL SELECT doc_id, 'bad' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that can be stored and the quarantined ones: every third gets a NUL."""
    from loomgraph.sources.tables import source_documents as split

    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text")))
    good, bad = split(docs)
    return good.select("doc_id", F.lit("good").alias("kind")).unionByName(bad.select("doc_id", F.lit("bad").alias("kind")))
