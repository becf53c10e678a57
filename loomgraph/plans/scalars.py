"""Queries of single-column functions and small operators, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import ids, temporal, text, vectors
from loomgraph.operators import calls, communities, evaluate, graph, intervals, merge
from loomgraph.plans.queries import _BOUNDS_SQL, _RELATE, _extents
from loomgraph.plans.registry import STAMP, query, stamp
from loomgraph.sources import domains
from loomgraph.sources.tables import EDGE_SQL, ENTITY_SQL, TENANT, edges, entities, table

# --- ids


def uuid5_sql(namespace: str, name: str, as_: str) -> str:
    """Two columns of a SELECT list: the digest, and the version-5 UUID called ``as_`` of it."""
    h = f"{as_}_h"
    return f"""sha1(unhex(replace({namespace}, '-', '')) || encode({name})) AS {h},
  {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || substr('89ab', CAST(('0x' || {h}[17:17])::INT % 4 + 1 AS INT), 1) || {h}[18:20] || '-' || {h}[21:32] AS {as_}"""


UNIT = "00000000-0000-5000-8000-000000000001"


@query(f"WITH x AS (SELECT p_partkey, {uuid5_sql(f"'{UNIT}'", 'p_brand', 'a')}, {uuid5_sql('a', 'lower(p_type)', 'b')}, {uuid5_sql('b', 'p_name', 'c')} FROM part) SELECT p_partkey, c AS id FROM x")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ids.entity_id(F.lit(UNIT), F.col("p_brand"), F.lower("p_type"), F.col("p_name")).alias("id"))


@query(f"""WITH x AS (SELECT o_orderkey, {uuid5_sql(f"'{ids.RELATIONSHIPS}'", "'c' || o_custkey", 'a')}, {uuid5_sql('a', "'o' || o_orderkey", 'b')}, {uuid5_sql('b', 'o_orderstatus', 'c')} FROM orders) SELECT o_orderkey, c AS id FROM x""")
def relationship_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ids.relationship_id(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("id"))


@query(f"""WITH x AS (SELECT c_custkey, {uuid5_sql("'6ba7b812-9dad-11d1-80b4-00c04fd430c8'", f"'alias:{TENANT}:c' || c_custkey", 'a')} FROM customer) SELECT c_custkey, a AS alias_id, '{TENANT}' AS stream FROM x""")
def alias_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("c"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ids.alias_id(F.lit(TENANT), own).alias("alias_id"), ids.consolidation_stream(F.lit(TENANT)).alias("stream"))


# --- text

_ODD = "'  ' || p_brand || ' - ' || p_type || '__' || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END || ' '"


@query(f"""WITH x AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({_ODD})), '[\\s-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS id FROM part)
SELECT p_partkey, id AS type_id, regexp_full_match(id, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*') AS good, 't:' || lower(p_type) AS type_key FROM x JOIN part USING (p_partkey)""")
def type_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("  "), "p_brand", F.lit(" - "), "p_type", F.lit("__"), F.when(F.col("p_partkey") % 3 == 0, "!").otherwise(""), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.type_id(odd).alias("type_id"), text.is_identifier(odd).alias("good"), text.type_key(F.col("p_type")).alias("type_key"))


@query("SELECT doc_id, doc_id % 5 = 0 AS bad FROM documents")
def unstorable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("text", 1, 3), F.lit("\0"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.unstorable(marked).alias("bad"))


@query(r"""WITH n AS (SELECT doc_id, lang, regexp_extract_all(lower(replace(replace(nfc_normalize(text), 'ß', 'ss'), 'ẞ', 'ss')), '[\p{L}\p{N}]+') AS words FROM documents)
SELECT doc_id, len(list_filter(words, lambda t: t NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + r"""))) AS n_tokens FROM n""")
def full_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens every text has after compatibility normalisation and full case folding."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"), exact=True)).cast("long").alias("n_tokens"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type END AS entity_type FROM part""")
def metadata_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reserved key of metadata: a text, a number, not there, and no JSON at all."""
    n = F.col("p_partkey") % 4
    meta = F.when(n == 0, F.to_json(F.struct(F.col("p_type").alias("entity_type"), F.col("p_size").alias("size")))).when(n == 1, F.to_json(F.struct(F.col("p_size").alias("entity_type")))).when(n == 2, F.lit('{"other": "x"}')).otherwise(F.lit("{broken"))
    return table(spark, sf_dir, "part").select("p_partkey", vectors.entity_type_of(meta).alias("entity_type"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}' AS stable FROM part""")
def stable_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    unordered = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", merge.stable_json(unordered).alias("stable"))


@query("""WITH h AS (SELECT p_partkey, sha256('0' || chr(1) || p_name) AS unused, sha256(encode('0') || '\\x00'::BLOB || encode('query: ' || p_name)) || sha256(encode('1') || '\\x00'::BLOB || encode('query: ' || p_name)) AS h FROM part),
v AS (SELECT p_partkey, list_transform(range(0, 48), lambda i: (CAST(('0x' || h[i * 2 + 1:i * 2 + 2])::INT AS DOUBLE) - 127.5) / 127.5) AS v FROM h)
SELECT p_partkey, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first, round(v[48] / sqrt(list_dot_product(v, v)), 5) AS last FROM v""")
def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.fake_embedding(F.col("p_name"), 48, "query: ")
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(F.col("v")[47].cast("double"), 5).alias("last"))


# --- versions


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_write(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""SELECT p_name AS name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size % 4 DESC, p_size % 3 = 0 DESC, length(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END) DESC, p_size % 5 <> 0 DESC,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END DESC, CASE WHEN p_size % 3 = 0 THEN '{"y":' || p_size || '}' ELSE '' END DESC, '{"brand":"' || p_brand || '"}' DESC, p_partkey) = 1""")
def preferred_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts with one name the preferred: confidence, a date, the description, the extent, the properties; then the first."""
    rows = table(spark, sf_dir, "part")
    dated = F.col("p_size") % 3 == 0
    order = merge.preference((F.col("p_size") % 4).cast("double"), dated, F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.col("p_name"), F.when(dated, F.concat(F.lit('{"y":'), F.col("p_size").cast("string"), F.lit("}"))), F.create_map(F.lit("brand"), F.col("p_brand")))
    return merge.best_version(rows, ["p_name"], order, "p_partkey").select(F.col("p_name").alias("name"), "p_partkey")


@query("""SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey % 3 DESC, '{"p":"' || o_orderpriority || '"}' DESC, o_orderkey) = 1""")
def preferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = merge.edge_preference((F.col("o_orderkey") % 3).cast("double"), F.create_map(F.lit("p"), F.col("o_orderpriority")))
    return merge.best_version(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], order, "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


# --- time

_MONTHS = "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(temporal.FULL_MONTHS, 1)) + " END"


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderdate AS d, lpad(CAST(year(o_orderdate) AS VARCHAR), 4, '0') AS y, {_MONTHS} AS m FROM orders)
SELECT id, CASE k WHEN 0 THEN 'circa ' || year(d) WHEN 1 THEN 'before ' || m || ' ' || y WHEN 2 THEN day(d) || ' ' || m || ' ' || y WHEN 3 THEN 'after ' || year(d) || '-' || (year(d) + 2) END AS written FROM o""")
def rendered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, months, days and spans as text; an hour can't be written so that it reads the same."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    start = F.when(k.isin(0, 3), F.date_trunc("year", d)).when(k == 1, F.date_trunc("month", d)).when(k == 2, d).otherwise(d + F.expr("interval 5 hours"))
    end = F.when(k == 3, F.date_trunc("year", d) + F.expr("interval 2 years"))
    precision = F.when(k.isin(0, 3), "year").when(k == 1, "month").when(k == 2, "day").otherwise("hour")
    marker = F.when(k == 0, "circa").when(k == 1, "before").when(k == 3, "after").otherwise("exact")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), temporal.render(start, end, precision, marker).alias("written"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_orderdate::TIMESTAMP AS d FROM orders)
SELECT id, strftime(CASE k WHEN 1 THEN d + INTERVAL 14 HOUR + INTERVAL 30 MINUTE WHEN 2 THEN d + INTERVAL 15 HOUR ELSE d END, {STAMP}) AS "start", CASE k WHEN 1 THEN 'minute' WHEN 2 THEN 'hour' ELSE 'day' END AS "precision",
  CASE k WHEN 3 THEN 'after' ELSE 'exact' END AS uncertainty FROM o""")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole dates, with and without a time of day, by the calendar parser."""
    d, k = F.col("o_orderdate"), (F.col("o_orderkey") % 4 + 1).cast("int")
    month = F.element_at(F.array(*map(F.lit, temporal.FULL_MONTHS)), F.month(d))
    day = F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, F.year(d).cast("string"))
    forms = [day, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 14:30")), F.concat(month, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"), F.lit(" 3 pm")), F.concat(F.lit("after "), day)]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), temporal.parse(F.element_at(F.array(*forms), k)).alias("e"))
    return rows.select("id", stamp(F.col("e.start_date")).alias("start"), "e.precision", "e.uncertainty")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderkey % 9 + 1 AS n, o_orderdate::TIMESTAMP AS d FROM orders)
SELECT id, strftime(CASE k WHEN 0 THEN d - INTERVAL 1 DAY WHEN 1 THEN d - n * INTERVAL 1 WEEK WHEN 2 THEN d + INTERVAL 1 MONTH WHEN 3 THEN d - INTERVAL 1 YEAR WHEN 4 THEN d + INTERVAL 1 DAY END, {STAMP}) AS "start" FROM o""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that need a reference date; the last form is none."""
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    forms = [F.lit("Yesterday"), F.concat(n, F.lit(" weeks ago")), F.lit("in a month"), F.lit("last year"), F.lit("next day"), F.lit("whenever it was")]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), temporal.parse(said, F.col("o_orderdate").cast("timestamp")).alias("e"))
    return rows.select("id", stamp(F.col("e.start_date")).alias("start"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, year(o_orderdate) AS y FROM orders)
SELECT id, CASE WHEN k IN (0, 1) THEN y END AS year, CASE k WHEN 2 THEN 'some time' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(y AS VARCHAR) END AS original, CASE WHEN k IN (1, 3) THEN 7 END AS sequence, k = 2 AS undatable, k IN (0, 1, 2) AS temporal, k <> 4 AS stated FROM o""")
def built_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date, a date with a sequence, a text that is no date, a sequence alone, and nothing."""
    k = F.col("o_orderkey") % 5
    said = F.when(k.isin(0, 1), F.year("o_orderdate").cast("string")).when(k == 2, "some time").when(k == 3, " ")
    made = temporal.build_extent(said, F.when(k.isin(1, 3), 7), calendar=False)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), made.alias("b"))
    return rows.select(
        "id", F.year("b.extent.start_date").cast("long").alias("year"), F.col("b.extent.original_text").alias("original"), "b.sequence", F.coalesce("b.undatable", F.lit(False)).alias("undatable"),
        temporal.is_temporal(F.col("b.extent")).alias("temporal"), F.col("b").isNotNull().alias("stated"),
    )


@query(f"""WITH {_BOUNDS_SQL}, q AS (SELECT TIMESTAMP '1997-03-01' AS lo, TIMESTAMP '1997-06-01' AS up), i AS (SELECT b.* FROM b, q WHERE {_RELATE.format('b', 'q')} NOT IN ('before', 'after')),
r AS (SELECT x.tenant_id, x.id AS a, y.id AS b, {_RELATE.format('x', 'y')} AS r FROM i x JOIN i y ON x.tenant_id = y.tenant_id AND x.id < y.id)
SELECT tenant_id, CASE WHEN r IN ('after', 'during') THEN b ELSE a END AS first, CASE WHEN r IN ('after', 'during') THEN a ELSE b END AS second, CASE r WHEN 'after' THEN 'before' WHEN 'during' THEN 'contains' ELSE r END AS relation FROM r WHERE r IN ('after', 'before', 'equals')""")
def relations_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = intervals.interval(F.lit("1997-03-01 00:00:00"), F.lit("1997-06-01 00:00:00"))
    return intervals.relations_in_interval(_extents(spark, sf_dir), asked, relations=("before", "equals"), max_pairs=None)


@query(f"""WITH {_BOUNDS_SQL}, q AS (SELECT TIMESTAMP '1997-03-01' AS lo, TIMESTAMP '1998-01-01' AS up), i AS (SELECT b.* FROM b JOIN orders ON o_orderkey = id, q WHERE o_orderstatus = 'F' AND {_RELATE.format('b', 'q')} NOT IN ('before', 'after'))
SELECT id FROM i""")
def timeline_of_a_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("entity_type"))
    asked = intervals.interval(F.lit("1997-03-01 00:00:00"), F.lit("1998-01-01 00:00:00"))
    return intervals.timeline(_extents(spark, sf_dir).join(kinds, "id"), asked, "F").select("id")


# --- calls


@query("SELECT event_id, least(60.0, 0.5 * pow(2.0, event_id % 12)) AS seconds FROM events")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", calls.delay(F.col("event_id") % 12, base=0.5).alias("seconds"))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id AS tenant, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s AS (
  SELECT tenant, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS until FROM o WHERE rn = 1
  UNION ALL SELECT o.tenant, o.event_id, o.rn, CASE WHEN s.n > 0 AND o.t < s.until THEN s.n + 1 ELSE 1 END, CASE WHEN s.n > 0 AND o.t < s.until THEN s.until ELSE o.t + 7200000000 END FROM s JOIN o ON o.tenant = s.tenant AND o.rn = s.rn + 1)
SELECT tenant, event_id, n FROM s WHERE rn > 0""")
def expiring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.expiring_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "ts", "event_id"), 7200)


# --- domains

_YAML = """
domain_id: {0}
display_name: {1}
version: 1.2.0
entity_types:
  - id: Sea Port
    description: where ships land
  - id: ship
relationship_types:
  - id: lands-at
    valid_source_types: [ship]
    valid_target_types: [sea port]
  - id: {2}
"""


def _schemas() -> dict[str, dict]:
    made = [domains.load_text(_YAML.format(*x)) for x in (("Trade Routes", "Trade", "owns"), ("harbours", "Harbours", "near"))]
    return {s["domain_id"]: s for s in made}


@query("""SELECT * FROM (VALUES ('harbours', 'Harbours', 2, 2, 'sea_port,ship', 'lands_at,near', true), ('trade_routes', 'Trade', 2, 2, 'sea_port,ship', 'lands_at,owns', true))
v(domain_id, display_name, entity_type_count, relationship_type_count, entity_types, relationship_types, has_ship)""")
def domain_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies from YAML, in order of their display names."""
    schemas = _schemas()
    ships = {s["domain_id"] for s in domains.with_entity_type(schemas, " SHIP ")}
    rows = [(s["domain_id"], s["display_name"], s["entity_type_count"], s["relationship_type_count"], ",".join(s["entity_types"]), ",".join(s["relationship_types"]), s["domain_id"] in ships) for s in domains.summaries(schemas)]
    return spark.createDataFrame(rows, "domain_id string, display_name string, entity_type_count int, relationship_type_count int, entity_types string, relationship_types string, has_ship boolean")


@query("""SELECT * FROM (VALUES ('lands_at', 'ship', 'sea_port'), ('near', '', '')) v(relationship_type, sources, targets)""")
def domain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = domains.get(_schemas(), "Harbours ")
    return domains.type_table(spark, schema).select("relationship_type", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'unknown_type' WHEN 1 THEN 'bad_source' WHEN 2 THEN 'bad_target' END AS problem FROM orders""")
def domain_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge of a type that isn't declared, from and to types that aren't allowed, a good one, and one of the type that always is."""
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "sinks").when(k == 4, domains.EXEMPT).otherwise("lands_at").alias("type"),
        F.when(k == 1, "sea_port").otherwise("ship").alias("source_type"), F.when(k == 2, "ship").otherwise("sea_port").alias("target_type"),
    )
    return domains.validate_edges(rows, domains.type_table(spark, _schemas()["harbours"])).select("id", "problem")


@query("""SELECT chr(10) AS nothing, 'Extract entities and relationships of the domain Harbours.' || chr(10) || 'Entity types:' || chr(10) || '- sea_port: where ships land' || chr(10) || '- ship' || chr(10) || 'Relationship types:' || chr(10) || '- lands_at (ship -> sea_port)' || chr(10) || '- near (any -> any)' AS prompt""")
def domain_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("\n", domains.system_prompt(_schemas()["harbours"]))], "nothing string, prompt string")


# --- themes

_NATION_OF = "g AS (SELECT src AS id, dst AS community FROM v_edge WHERE type = 'located_in')"
_DEGREES = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM v_edge UNION ALL SELECT dst FROM v_edge) GROUP BY id)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by nation."""
    e = edges(spark, sf_dir)
    found = e.filter("type = 'located_in'").select(F.lit(TENANT).alias("tenant_id"), F.col("src").alias("id"), F.col("dst").alias("community"))
    return communities.shown_members(found, graph.degrees(e), 3)


@query(f"WITH {EDGE_SQL}, {_NATION_OF}, {_DEGREES}, r AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS rank, count(*) OVER (PARTITION BY community) AS size FROM g LEFT JOIN d USING (id)) SELECT * FROM r WHERE rank <= 3 AND size >= 2")
def theme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best connected members of each group of two or more."""
    return _members(spark, sf_dir).select("community", "id", F.col("rank").cast("long").alias("rank"), "size")


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL}, {_NATION_OF}, {_DEGREES}, r AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS rank, count(*) OVER (PARTITION BY community) AS size FROM g LEFT JOIN d USING (id)),
p AS (SELECT community, string_agg('- ' || name || ' (' || entity_type || ')', chr(10) ORDER BY rank) AS prompt FROM r JOIN v_entity USING (id) WHERE rank <= 3 AND size >= 2 GROUP BY community)
SELECT community, prompt, 'T' || length(prompt) AS title, CASE WHEN community = 'n3' THEN NULL ELSE prompt[1:5] END AS summary FROM p WHERE community <> 'n3' UNION ALL SELECT community, NULL, NULL, NULL FROM p WHERE community = 'n3'""")
def theme_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each group and what the model's stand-in says to it; one call fails and is passed over."""
    prompts = communities.theme_prompts(_members(spark, sf_dir), entities(spark, sf_dir))
    marked = prompts.withColumn("prompt", F.when(F.col("community") == "n3", "fail").otherwise(F.col("prompt")))
    said = communities.themes(marked, _theme, skip_failed=True)
    return said.join(prompts.select("community", F.col("prompt").alias("p")), "community").select("community", F.when(~F.col("failed"), F.col("p")).alias("prompt"), "title", "summary")


def _theme(prompt: str) -> tuple[str, str]:
    if prompt == "fail":
        raise RuntimeError("no answer")
    return f"T{len(prompt)}", prompt[:5]


@query(f"""WITH {EDGE_SQL}, {_NATION_OF}, m AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY id) AS rank FROM g),
c AS (SELECT 'o' || o_orderkey AS chunk_id, 's' || o_custkey % 10 AS source_id, o_orderkey % 100 AS i, 'c' || o_custkey AS id FROM orders),
k AS (SELECT community, chunk_id, min({{'a': rank, 'b': source_id, 'c': i, 'd': chunk_id}}) AS o FROM m JOIN c USING (id) GROUP BY ALL)
SELECT community, chunk_id, row_number() OVER (PARTITION BY community ORDER BY o) AS place FROM k QUALIFY place <= 4""")
def theme_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four passages that mention a group's members."""
    from pyspark.sql import Window

    members = edges(spark, sf_dir).filter("type = 'located_in'").select(F.col("dst").alias("group"), F.col("src").alias("entity_id"), F.row_number().over(Window.partitionBy("dst").orderBy("src")).alias("rank"))
    chunks = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("source_id"), (F.col("o_orderkey") % 100).alias("chunk_index"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("entity_ids"))
    return graph.passages(members, chunks, 4).select(F.col("group").alias("community"), "chunk_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ENTITY_SQL}, {EDGE_SQL}, a AS (SELECT DISTINCT src, dst, type FROM v_edge WHERE type <> 'supplies' UNION SELECT 's' || s_suppkey, 'gone', 'located_in' FROM supplier),
n AS (SELECT DISTINCT x.name AS s, y.name AS t, type FROM a JOIN v_entity x ON x.id = src JOIN v_entity y ON y.id = dst), e AS (SELECT DISTINCT s_name AS s, n_name AS t, 'located_in' AS type FROM supplier, nation WHERE n_nationkey IN (s_nationkey, (s_nationkey + 1) % 25))
SELECT (SELECT count(*) FROM n JOIN e USING (s, t, type)) AS tp, (SELECT count(*) FROM n ANTI JOIN e USING (s, t, type)) + (SELECT count(*) FROM supplier) AS fp, (SELECT count(*) FROM e ANTI JOIN n USING (s, t, type)) AS fn""")
def relationship_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges against expected names: each supplier is expected in its nation and in the next; edges into nowhere are wrong."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    near = s.join(n, (F.col("n_nationkey") == F.col("s_nationkey")) | (F.col("n_nationkey") == (F.col("s_nationkey") + 1) % 25))
    expected = near.select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("located_in").alias("type"))
    loose = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("gone").alias("dst"), F.lit("located_in").alias("type"))
    return evaluate.confusion_of_relationships(expected, edges(spark, sf_dir).filter("type <> 'supplies'").select("src", "dst", "type").unionByName(loose), entities(spark, sf_dir))
