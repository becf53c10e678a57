"""Tables on Parquet with keys: upsert, delete, replace, purge; and the graph, vector and passage stores made of them.

A write touches the partitions of its own tenants only: it writes their new rows under a new version, then publishes a manifest
that says which version each tenant has. Manifests are numbered and made by a rename that fails if the number is taken, so a
reader sees all of a write or nothing, and of two writers that began from one manifest the later raises ``ConcurrentWrite``.
Files of older versions stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.functions.vectors import has_zero_norm
from loomgraph.operators import graph, lexical, search
from loomgraph.operators.merge import last_write
from loomgraph.sources.shared import materialise


class ConcurrentWrite(RuntimeError):
    """Another writer published first; read again and retry."""


class KeyedTable:
    """Rows with ``tenant_id`` and the key columns, one row for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...] = ("tenant_id", "id")) -> None:
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """The newest number and the version of each tenant."""
        fs, folder = self._fs(), self._at("manifests")
        if not fs.exists(folder):
            return 0, {}
        newest = max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)
        if not newest:
            return 0, {}
        stream = fs.open(self._at(f"manifests/{newest}"))
        try:
            return newest, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, versions: dict[str, str]) -> None:
        jvm = self.spark._jvm
        fs, draft, final = self._fs(), self._at(f"manifests/draft-{uuid.uuid4().hex}"), self._at(f"manifests/{number + 1}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentWrite(self.path) from e
            raise

    def _folder(self, version: str, tenant: str) -> str:
        return f"{version}/tenant_id={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)}"

    def _read(self, versions: dict[str, str]) -> DataFrame:
        by: dict[str, list[str]] = {}
        for tenant, version in versions.items():
            by.setdefault(version, []).append(tenant)
        names = self.schema.fieldNames()
        found = self.spark.createDataFrame([], self.schema)
        for k, (version, tenants) in enumerate(sorted(by.items())):
            paths = [f"{self.path}/{self._folder(version, t)}" for t in tenants]
            part = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{version}").parquet(*paths).select(*names)
            found = part if k == 0 else found.unionByName(part)
        return found

    def _commit(self, number: int, versions: dict[str, str], rows: DataFrame, touched: list[str]) -> None:
        version = uuid.uuid4().hex
        rows, kept, fs = rows.select(*self.schema.fieldNames()), {t: v for t, v in versions.items() if t not in touched}, self._fs()
        if len(touched) == 1 and touched[0]:  # a writer of several folders sorts all rows of a task by tenant first
            folder = f"{self.path}/{self._folder(version, touched[0])}"
            rows.drop("tenant_id").write.parquet(folder)
            there = [] if self.spark.read.schema(self.schema).parquet(folder).isEmpty() else touched
        else:
            rows.write.partitionBy("tenant_id").parquet(f"{self.path}/{version}")
            there = [t for t in touched if fs.exists(self._at(self._folder(version, t)))]
        self._publish(number, kept | dict.fromkeys(there, version))

    def read(self, tenant_id: str | None = None) -> DataFrame:
        """All rows, or one tenant's; other tenants' files aren't opened."""
        versions = self._manifest()[1]
        return self._read(versions if tenant_id is None else {t: v for t, v in versions.items() if t == tenant_id})

    def get(self, tenant_id: str, **key) -> DataFrame:
        found = self.read(tenant_id)
        for name, value in key.items():
            found = found.filter(F.col(name) == value)
        return found

    @staticmethod
    def _tenants(rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select("tenant_id").distinct().collect()]

    def upsert(self, rows: DataFrame, ordinal: str | None = None) -> list[str]:
        """Later rows replace earlier ones, in the table and (by ``ordinal``) within the batch. The tenants that were written."""
        fresh = last_write(rows, self.keys, ordinal) if ordinal else rows.dropDuplicates(self.keys)
        fresh = fresh.select(*self.schema.fieldNames())
        touched = self._tenants(rows)
        number, versions = self._manifest()
        held = {t: v for t, v in versions.items() if t in touched}
        self._commit(number, versions, self._read(held).join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh) if held else fresh, touched)
        return touched

    def delete(self, keys: DataFrame) -> int:
        """How many of the keys existed."""
        touched = self._tenants(keys)
        number, versions = self._manifest()
        old = self._read({t: v for t, v in versions.items() if t in touched})
        hit = old.join(keys.select(*self.keys), self.keys, "left_semi").count()
        if hit:
            self._commit(number, versions, old.join(keys.select(*self.keys), self.keys, "left_anti"), touched)
        return hit

    def delete_where(self, tenant_id: str, **values) -> int:
        """Purge a tenant, or its rows with these values (one source); how many went. A purge writes no rows."""
        number, versions = self._manifest()
        old = self._read({t: v for t, v in versions.items() if t == tenant_id})
        gone = F.lit(True)
        for name, value in values.items():
            gone = gone & F.coalesce(F.col(name) == value, F.lit(False))
        n = old.filter(gone).count()
        if n and values:
            self._commit(number, versions, old.filter(~gone), [tenant_id])
        elif n:
            self._publish(number, {t: v for t, v in versions.items() if t != tenant_id})
        return n

    def replace_source(self, tenant_id: str, source_id: str, rows: DataFrame) -> int:
        """The source's rows become ``rows``; how many old ones no longer exist. A foreign row is an error."""
        reject_foreign(rows, tenant_id, source_id)
        number, versions = self._manifest()
        old = self._read({t: v for t, v in versions.items() if t == tenant_id})
        mine = F.coalesce(F.col("source_id") == source_id, F.lit(False))
        lost = orphans(old.filter(mine), rows, self.keys).count()
        fresh = rows.dropDuplicates(self.keys).select(*self.schema.fieldNames())
        rest = old.filter(~mine).join(fresh.select(*self.keys), self.keys, "left_anti")
        self._commit(number, versions, rest.unionByName(fresh), [tenant_id])
        return lost

    def replace_sources(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """The rows of all ``sources`` (tenant_id, source_id) become ``rows``, in one write; tenant_id, source_id, lost of each: how
        many old rows no longer exist. A source without new rows loses all it had; a row of another source is an error."""
        if not rows.join(sources, ["tenant_id", "source_id"], "left_anti").isEmpty():
            raise ValueError("a row belongs to another source or tenant")
        touched = self._tenants(sources)
        number, versions = self._manifest()
        old = self._read({t: v for t, v in versions.items() if t in touched})
        own = ["tenant_id", "source_id"]
        lost = orphans(old.join(sources, own, "left_semi"), rows, self.keys).groupBy(*own).agg(F.count("*").alias("lost"))
        lost = materialise(sources.distinct().join(lost, own, "left").select(*own, F.coalesce("lost", F.lit(0)).alias("lost")), "lost")
        fresh = rows.dropDuplicates(self.keys).select(*self.schema.fieldNames())
        rest = old.join(sources, own, "left_anti").join(fresh.select(*self.keys), self.keys, "left_anti")
        self._commit(number, versions, rest.unionByName(fresh), touched)
        return lost

    def vacuum(self) -> int:
        """Delete the files of versions that the newest manifest doesn't name; how many versions went. No reader may be at work."""
        fs, kept = self._fs(), set(self._manifest()[1].values())
        gone = [f.getPath() for f in fs.listStatus(self._at("")) if f.getPath().getName() not in kept | {"manifests"}]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def orphans(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key the new ones lack."""
    return old.join(new.select(*keys), keys, "left_anti")


def foreign(rows: DataFrame, tenant_id: str, source_id: str) -> DataFrame:
    """Rows of another source or tenant."""
    return rows.filter(~(F.col("tenant_id").eqNullSafe(F.lit(tenant_id)) & F.col("source_id").eqNullSafe(F.lit(source_id))))


def reject_foreign(rows: DataFrame, tenant_id: str, source_id: str) -> None:
    if not foreign(rows, tenant_id, source_id).isEmpty():
        raise ValueError("a row belongs to another source or tenant")


class GraphStore:
    """Entities, relationships and aliases of many tenants."""

    ENTITY = "tenant_id string, id string, name string, entity_type string, blocking_keys array<string>"
    EDGE = "tenant_id string, id string, src string, dst string, type string"
    ALIAS = "tenant_id string, alias string, canonical string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.entities = KeyedTable(spark, f"{path}/entities", self.ENTITY)
        self.edges = KeyedTable(spark, f"{path}/edges", self.EDGE)
        self.aliases = KeyedTable(spark, f"{path}/aliases", self.ALIAS, ("tenant_id", "alias"))

    def upsert_relationships(self, rows: DataFrame) -> None:
        """All or nothing: an edge without one of its ends in the store is an error, and then none is written."""
        for tenant in KeyedTable._tenants(rows):
            graph.require_endpoints(rows.filter(F.col("tenant_id") == tenant), self.entities.read(tenant))
        self.edges.upsert(rows)

    def relationships(self, tenant_id: str, one: str, *, direction: str = "both", types: list[str] | None = None) -> DataFrame:
        return graph.touching(self.edges.read(tenant_id), one=one, direction=direction, types=types)

    def find_aliases(self, tenant_id: str, canonical: str) -> DataFrame:
        """Direct aliases, in order of the alias."""
        return self.aliases.get(tenant_id, canonical=canonical).orderBy("alias")

    def delete_by_tenant(self, tenant_id: str) -> int:
        """Everything of the tenant goes; how many entities that were."""
        for t in (self.edges, self.aliases):
            t.delete_where(tenant_id)
        return self.entities.delete_where(tenant_id)


def vector_problems(rows: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """id, problem (width, zero_norm) of the vectors that can't be stored; rows without a vector have none."""
    there = rows.filter(F.col(vector).isNotNull())
    problem = F.when(F.size(vector) != dimension, "width").when(has_zero_norm(F.col(vector)), "zero_norm")
    return there.select("id", problem.alias("problem")).filter("problem is not null")


class VectorStore(KeyedTable):
    """Vectors of one width; searches are exact."""

    VECTOR = "tenant_id string, id string, entity_type string, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str, dimension: int) -> None:
        super().__init__(spark, path, self.VECTOR)
        self.dimension = dimension

    def upsert_many(self, rows: DataFrame) -> None:
        """Every row is checked before any is written."""
        bad = vector_problems(rows, self.dimension).first()
        if bad:
            raise ValueError(f"vector {bad['id']}: {bad['problem']}")
        self.upsert(rows)

    def search(self, tenant_id: str, query: list[float], k: int | None, **options) -> DataFrame:
        return search.knn(self.read(tenant_id), query, k, **options)


class PassageStore(KeyedTable):
    """Passages by id, with a written index of their terms that every write keeps up."""

    PASSAGE = "tenant_id string, id string, source_id string, chunk_index int, text string, entity_ids array<string>, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None) -> None:
        super().__init__(spark, f"{path}/passages", self.PASSAGE)
        self.dimension = dimension
        self.terms = KeyedTable(spark, f"{path}/terms", "tenant_id string, term string, id string, tf long, doc_length int", ("tenant_id", "term", "id"))
        self.lengths = KeyedTable(spark, f"{path}/lengths", "tenant_id string, id string, doc_length int")

    def _index(self, tenants: list[str]) -> int:
        passages = self._read({t: v for t, v in self._manifest()[1].items() if t in tenants})
        for table, rows in ((self.terms, lexical.index_rows(passages)), (self.lengths, lexical.lengths(passages))):
            number, versions = table._manifest()
            table._commit(number, versions, rows, tenants)
        return passages.count()

    def upsert_many(self, rows: DataFrame) -> None:
        if self.dimension is not None:
            bad = vector_problems(rows, self.dimension).first()
            if bad:
                raise ValueError(f"passage {bad['id']}: {bad['problem']}")
        self._index(self.upsert(rows))

    def replace_source(self, tenant_id: str, source_id: str, rows: DataFrame) -> int:
        lost = super().replace_source(tenant_id, source_id, rows)
        self._index([tenant_id])
        return lost

    def replace_sources(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        lost = super().replace_sources(rows, sources)
        self._index(self._tenants(sources))
        return lost

    def delete_where(self, tenant_id: str, **values) -> int:
        n = super().delete_where(tenant_id, **values)
        if n:
            self._index([tenant_id])
        return n

    def backfill(self) -> int:
        """Make the index anew from all passages; how many there are. Doing it again changes nothing."""
        return self._index(sorted(set(self._manifest()[1]) | set(self.terms._manifest()[1])))

    def by_source(self, tenant_id: str, source_id: str) -> DataFrame:
        return self.get(tenant_id, source_id=source_id).orderBy("chunk_index", "id")

    def by_entity(self, tenant_id: str, entity_id: str) -> DataFrame:
        return self.read(tenant_id).filter(F.array_contains("entity_ids", entity_id)).orderBy("source_id", "chunk_index", "id")

    def rank(self, tenant_id: str, terms: list[str], k: int | None, candidates: int | None = None) -> DataFrame:
        """BM25 by the index: the asked terms' rows only, no text is read."""
        return lexical.rank_indexed(self.terms.read(tenant_id), self.lengths.read(tenant_id), terms, k, candidates)
