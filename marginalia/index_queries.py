"""Queries for the index's own operators over the star-schema tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, configuration_hash
from marginalia.functions.canon import canon
from marginalia.functions.chunking import chunks as chunked
from marginalia.functions.hashing import content_hash, provenance_hash, vector_width
from marginalia.functions.vectors import parse_vector
from marginalia.plans import drift as drifts
from marginalia.plans import embed as embeds
from marginalia.plans import invalidate, reconcile
from marginalia.plans import search as searches
from marginalia.plans.render import dependencies, render, render_hashed
from marginalia.runtime import cut_lineage
from marginalia.sources.tables import micros, table
from marginalia.spec import DocumentSpec, EntityCatalog, Relation

CONFIG = EngineConfig()
#: The vector all search queries ask with: 64 values that any engine computes alike.
QUERY = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_QUERY_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"


def catalog(spark: SparkSession, d: str, *wanted: str) -> EntityCatalog:
    """The wanted entities (customer, order, part, product) with what they are related to."""
    c = EntityCatalog()
    if {"customer", "order"} & set(wanted):
        c.register("region", table(spark, d, "region"), "r_regionkey")
        c.register("nation", table(spark, d, "nation"), "n_nationkey", {"region": Relation("one", "region", local="n_regionkey")})
        customer = {"nation": Relation("one", "nation", local="c_nationkey"), "orders": Relation("many", "order", foreign="o_custkey", order_by=("o_orderdate",))}
        c.register("customer", table(spark, d, "customer"), "c_custkey", customer, DocumentSpec(("c_name", "c_acctbal", "c_mktsegment"), ("nation.n_name", "nation.region.r_name")))
    if "order" in wanted:
        c.register("order", table(spark, d, "orders"), "o_orderkey", {"customer": Relation("one", "customer", local="o_custkey")}, DocumentSpec(("o_orderkey", "o_orderdate"), ("customer.c_name",)))
    if "part" in wanted:
        c.register("supplier", table(spark, d, "supplier"), "s_suppkey")
        bridge = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
        part = {"suppliers": Relation("bridge", "supplier", local="l_partkey", foreign="l_suppkey", bridge=bridge)}
        c.register("part", table(spark, d, "part"), "p_partkey", part, DocumentSpec(("p_name", "p_size", "p_retailprice"), ("suppliers.s_name",)))
    if "product" in wanted:
        product = {"category": Relation("one", "category", local="category_id"), "brand": Relation("one", "brand", local="brand_id")}
        for name, rows in (("category", "categories"), ("brand", "brands")):
            c.register(name, table(spark, d, rows), "id")
        c.register("product", table(spark, d, "products").dropDuplicates(["id"]), "id", product, DocumentSpec(("name", "sku", "price"), ("category.name", "brand.name")))
    return c


# -- render ----------------------------------------------------------------


def render_belongs_to(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d, "customer")
    return render_hashed(c, "customer", configuration_hash(c["customer"].spec, CONFIG)).select("entity_id", "text", "content_hash")


_FLOAT = "regexp_replace(CAST(CAST(round({0}, 6) AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"
_CUSTOMER_TEXT = f"""
SELECT c_custkey AS entity_id, 'c_name: ' || coalesce(c_name, '') || chr(10) || 'c_acctbal: ' || coalesce({_FLOAT.format("c_acctbal")}, '') || chr(10)
  || 'c_mktsegment: ' || coalesce(c_mktsegment, '') || chr(10) || 'nation.n_name: ' || coalesce(n_name, '') || chr(10) || 'nation.region.r_name: ' || coalesce(r_name, '') AS text
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
RENDER_BELONGS_TO = f"SELECT *, sha256(text) AS content_hash FROM ({_CUSTOMER_TEXT})"


def render_decimal(spark: SparkSession, d: str) -> DataFrame:
    """Products: decimals keep their scale, null relations and prices are empty."""
    return render(catalog(spark, d, "product"), "product")


RENDER_DECIMAL = """
SELECT p.id AS entity_id, 'name: ' || coalesce(p.name, '') || chr(10) || 'sku: ' || coalesce(sku, '') || chr(10) || 'price: ' || coalesce(CAST(price AS VARCHAR), '') || chr(10)
  || 'category.name: ' || coalesce(c.name, '') || chr(10) || 'brand.name: ' || coalesce(b.name, '') AS text
FROM (SELECT DISTINCT * FROM products) p LEFT JOIN categories c ON category_id = c.id LEFT JOIN brands b ON brand_id = b.id"""


def render_many_to_many(spark: SparkSession, d: str) -> DataFrame:
    return render(catalog(spark, d, "part"), "part")


RENDER_MANY_TO_MANY = f"""
WITH pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
listed AS (SELECT l_partkey, string_agg(coalesce(s_name, ''), ', ' ORDER BY coalesce(s_name, '')) AS names FROM pairs JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT p_partkey AS entity_id, 'p_name: ' || coalesce(p_name, '') || chr(10) || 'p_size: ' || coalesce(CAST(p_size AS VARCHAR), '') || chr(10)
  || 'p_retailprice: ' || coalesce({_FLOAT.format("p_retailprice")}, '') || chr(10) || 'suppliers.s_name: ' || coalesce(names, '') AS text
FROM part LEFT JOIN listed ON p_partkey = l_partkey"""


def render_ordered(spark: SparkSession, d: str) -> DataFrame:
    """A customer's order dates in their own order (1:n, order kept)."""
    spec = DocumentSpec(("c_name",), ("orders.o_orderkey",), ("orders.o_orderkey",))
    return render(catalog(spark, d, "order"), "customer", spec)


RENDER_ORDERED = """
SELECT c_custkey AS entity_id, 'c_name: ' || c_name || chr(10) || 'orders.o_orderkey: ' || coalesce(keys, '') AS text
FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY ALL) ON c_custkey = o_custkey"""


def render_nested_lists(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders' customers' names: to-many and back, sorted as text."""
    return render(catalog(spark, d, "order"), "customer", DocumentSpec((), ("orders.customer.c_name", "orders.o_orderkey")))


RENDER_NESTED = """
SELECT c_custkey AS entity_id, 'orders.customer.c_name: ' || coalesce(names, '') || chr(10) || 'orders.o_orderkey: ' || coalesce(keys, '') AS text
FROM customer LEFT JOIN (
  SELECT o_custkey, string_agg(c_name, ', ' ORDER BY c_name) AS names, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS keys
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON c_custkey = o_custkey"""


def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    """Events: a float, a time and an integer as canonical text."""
    rows = table(spark, d, "events")
    kind = {f.name: f.dataType for f in rows.schema}
    return rows.select("event_id", *[canon(F.col(c), kind[c]).alias(f"{c}_text") for c in ("value", "ts", "user_id")])


CANONICAL_VALUES = f"""
SELECT event_id, coalesce({_FLOAT.format("value")}, '') AS value_text, coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', '') AS ts_text,
  coalesce(CAST(user_id AS VARCHAR), '') AS user_id_text FROM events"""


def config_hash(spark: SparkSession, d: str) -> DataFrame:
    spec = DocumentSpec(("name", "sku", "price"), ("category.name", "brand.name", "features.name"))
    return spark.createDataFrame([(configuration_hash(spec, CONFIG),)], "configuration_hash string")


CONFIG_HASH = """
SELECT sha256('{"chunk":{"max_tokens":400,"overlap":40,"tokenizer":"whitespace"},"content":["name","sku","price"],"embedding":{"dimensions":1536,"model":"text-embedding-3-small","provider":null},"orderedPaths":[],"relations":["category.name","brand.name","features.name"]}') AS configuration_hash"""


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_chunks").select("id", provenance_hash(F.col("content_hash"), "openai", "text-embedding-3-small", 1536).alias("embedding_hash")).where("id IS NOT NULL").distinct()


PROVENANCE = """
SELECT DISTINCT id, sha256('{"contentHash":"' || content_hash || '","dimensions":1536,"model":"text-embedding-3-small","provider":"openai"}') AS embedding_hash FROM rag_chunks WHERE id IS NOT NULL"""


# -- chunk -----------------------------------------------------------------


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    small = CONFIG.with_(max_tokens=100, overlap=10)
    return chunked(table(spark, d, "documents"), ["doc_id"], "text", small).select("doc_id", "chunk_index", "content_hash")


_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = rf"""
WITH trimmed AS (SELECT doc_id, regexp_replace(text, '^[ \n\r\t\x0B\x00]+|[ \n\r\t\x0B\x00]+$', '', 'g') AS t FROM documents),
tokens AS (SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN [] ELSE regexp_split_to_array(t, '{_BLANKS}') END AS tok FROM trimmed),
starts AS (SELECT doc_id, tok, unnest(range(0, 1 + greatest(0, CAST(ceil((len(tok) - 100) / 90.0) AS BIGINT)))) AS i FROM tokens WHERE len(tok) > 0)
"""
CHUNK_TEXT = _TOKENS + "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, sha256(array_to_string(tok[i * 90 + 1 : i * 90 + 100], ' ')) AS content_hash FROM starts"


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunk_text(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


CHUNK_COUNTS = _TOKENS + "SELECT doc_id, count(*) AS chunks FROM starts GROUP BY ALL"


def chunk_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of vocabulary tokens instead of words."""
    own = CONFIG.with_(max_tokens=200, overlap=20, tokenizer="tiktoken")
    return chunked(table(spark, d, "documents"), ["doc_id"], "text", own).select("doc_id", "chunk_index", "content_hash")


# -- search ----------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("entity_id"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit("").alias("content_hash"), "embedding")


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.select("entity_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "chunk_index")


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return searches.rank(_vectors(spark, d), QUERY, 5).select("entity_id")


def search_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(searches.rank(_vectors(spark, d), QUERY, 5))


def search_vectorised(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(searches.rank(_vectors(spark, d), QUERY, 5, mode="vectorised"))


def search_min_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(searches.rank(_vectors(spark, d), QUERY, 100, min_similarity=0.15))


def search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(searches.rank(_vectors(spark, d), QUERY, 100, scope=F.col("entity_id") % 2 == 0))


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents closest to the query by the stored chunks, unusable vectors among them."""
    rows = table(spark, d, "rag_chunks").where("id IS NOT NULL").select(F.col("document_id").alias("entity_id"), "chunk_index", "content_hash", "embedding")
    return _rounded(searches.rank(rows, QUERY, 20))


def search_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """The nations the closest labels stand for; labels without one leave fewer rows."""
    ranked = searches.rank(_vectors(spark, d), QUERY, 8)
    return searches.hydrated(ranked, table(spark, d, "nation").where("n_nationkey <> 3"), "n_nationkey").select("place", "entity_id", "n_name")


def _search_sql(table_sql: str, where: str, limit: int, columns: str = "entity_id, round(d, 6) AS distance, round(1 - d, 6) AS score, chunk_index") -> str:
    return f"""
WITH v AS ({table_sql}),
dist AS (SELECT entity_id, chunk_index, 1 - list_dot_product(e, {_QUERY_SQL}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_QUERY_SQL}, {_QUERY_SQL}))) AS d FROM v WHERE {where}),
best AS (SELECT entity_id, min(d) AS d, arg_min(chunk_index, (d, chunk_index)) AS chunk_index FROM dist GROUP BY entity_id ORDER BY d, entity_id LIMIT {limit})
SELECT {columns} FROM best"""


_EMBEDDINGS_SQL = "SELECT CAST(label AS BIGINT) AS entity_id, CAST(vec_id AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_NEAR = f"1 - list_dot_product(e, {_QUERY_SQL}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_QUERY_SQL}, {_QUERY_SQL}))) <= 1 - 0.15"
_CHUNKS_SQL = """SELECT document_id AS entity_id, chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM rag_chunks
  WHERE id IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"""


# -- dependencies, fan-out, throttle ---------------------------------------


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d, "customer", "part")
    return reduce(DataFrame.unionByName, [dependencies(c, t).select(F.lit(t).alias("entity_type"), F.col("entity_id").cast("bigint").alias("entity_id"), "dependency_type", "dependency_id") for t in ("customer", "part")])


def deps_desired(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(spark, d)


DEPS_DESIRED = """
SELECT 'customer' AS entity_type, c_custkey AS entity_id, 'nation' AS dependency_type, CAST(n_nationkey AS BIGINT) AS dependency_id FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'customer', c_custkey, 'region', CAST(r_regionkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION SELECT 'part', p_partkey, 'supplier', s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Nations of region 1 and every seventh supplier have changed."""
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.lit("nation").alias("dependency_type"), F.col("n_nationkey").cast("bigint").alias("dependency_id"))
    return nations.unionByName(table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.lit("supplier").alias("dependency_type"), F.col("s_suppkey").alias("dependency_id")))


def fanout_pairs(spark: SparkSession, d: str) -> DataFrame:
    return invalidate.affected(_changes(spark, d), _dependencies(spark, d))


_AFFECTED = f"""
WITH deps AS ({DEPS_DESIRED}), changes AS (
  SELECT 'nation' AS dependency_type, CAST(n_nationkey AS BIGINT) AS dependency_id FROM nation WHERE n_regionkey = 1
  UNION SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey % 7 = 0),
pairs AS (SELECT DISTINCT entity_type, entity_id FROM deps JOIN changes USING (dependency_type, dependency_id))
"""
FANOUT_PAIRS = _AFFECTED + "SELECT * FROM pairs"


def fanout_batches(spark: SparkSession, d: str) -> DataFrame:
    return invalidate.fan_out(_changes(spark, d), _dependencies(spark, d), 500)


FANOUT_BATCHES = _AFFECTED + "SELECT *, (row_number() OVER (ORDER BY entity_type, entity_id) - 1) // 500 AS batch_no FROM pairs"


def fanout_stored(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the stored dependencies that depend on any category, in batches of 500 by document."""
    from marginalia.sources.tables import kind_of

    stored = table(spark, d, "rag_dependencies").where("id IS NOT NULL AND document_id IS NOT NULL").select(F.col("document_id").alias("entity_id"), kind_of(F.col("dependency_type")).alias("dependency_type"), "dependency_id")
    changes = table(spark, d, "categories").select(F.lit("category").alias("dependency_type"), F.col("id").alias("dependency_id"))
    return invalidate.fan_out(changes, stored, 500, ("entity_id",))


FANOUT_STORED = r"""
WITH pairs AS (SELECT DISTINCT document_id AS entity_id FROM rag_dependencies WHERE id IS NOT NULL AND document_id IS NOT NULL
  AND lower(trim(list_last(string_split(dependency_type, '\')))) = 'category' AND dependency_id IN (SELECT id FROM categories))
SELECT entity_id, (row_number() OVER (ORDER BY entity_id) - 1) // 500 AS batch_no FROM pairs"""

_DAY = 86_400_000_000


def throttle_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user that pass a throttle of one day."""
    return invalidate.throttle(table(spark, d, "events").select("user_id", micros(F.col("ts")).alias("us")), ["user_id"], "us", _DAY).withColumnRenamed("at", "us")


THROTTLE_EVENTS = f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
passed AS (
  SELECT user_id, min(us) AS us FROM e GROUP BY user_id
  UNION ALL
  SELECT p.user_id, (SELECT min(us) FROM e WHERE e.user_id = p.user_id AND e.us >= p.us + {_DAY}) FROM passed p
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = p.user_id AND e.us >= p.us + {_DAY}))
SELECT user_id, us FROM passed"""


# -- reconcile and drift ---------------------------------------------------


def _generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(desired, stored): rendered customers, and the same with some gone, some of another text or configuration."""
    desired = render_hashed(catalog(spark, d, "customer"), "customer", "g1").select("entity_id", "content_hash", "configuration_hash", "text")
    stored = desired.where("entity_id % 10 <> 0").select(
        "entity_id", F.lit(1).alias("version"), F.when(F.col("entity_id") % 7 == 0, content_hash(F.concat("text", F.lit("!")))).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("entity_id") % 13 == 0, "g0").otherwise(F.col("configuration_hash")).alias("configuration_hash"), F.lit("synced").alias("status"), F.lit(None).cast("string").alias("last_error"),
        *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("synced_at", "created_at", "updated_at")],
    )
    gone = spark.createDataFrame([(-1,), (-2,)], "entity_id bigint").select("entity_id", F.lit(1).alias("version"), F.lit("x").alias("content_hash"), F.lit("g1").alias("configuration_hash"), F.lit("synced").alias("status"), F.lit(None).cast("string").alias("last_error"), *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("synced_at", "created_at", "updated_at")])
    return desired, stored.unionByName(gone)


def reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.actions(*_generations(spark, d))


RECONCILE_ACTIONS = """
SELECT c_custkey AS entity_id, c_custkey % 10 <> 0 AS existed, c_custkey % 10 = 0 OR c_custkey % 7 = 0 OR c_custkey % 13 = 0 AS is_changed,
  c_custkey % 10 <> 0 AND c_custkey % 13 = 0 AS configuration_changed FROM customer"""


def reconcile_documents(spark: SparkSession, d: str) -> DataFrame:
    desired, stored = _generations(spark, d)
    new = reconcile.new_documents(desired, stored, force=True, now=F.lit("2025-01-01").cast("timestamp"))
    return new.select("entity_id", "version", "content_hash", "configuration_hash", "status", F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))


RECONCILE_DOCUMENTS = f"""
SELECT entity_id, CASE WHEN entity_id % 10 <> 0 THEN 2 ELSE 1 END AS version, sha256(text) AS content_hash, 'g1' AS configuration_hash, 'pending' AS status,
  CASE WHEN entity_id % 10 <> 0 THEN 2024 ELSE 2025 END AS created, 2025 AS updated FROM ({_CUSTOMER_TEXT})
UNION ALL SELECT * FROM (VALUES (-1, 1, 'x', 'g1', 'synced', 2024, 2024), (-2, 1, 'x', 'g1', 'synced', 2024, 2024))"""


def embedding_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a pass in which every third text got longer, every fifth shorter and some have another configuration: which chunks and vectors stayed."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    small = CONFIG.with_(max_tokens=100, overlap=10)
    stored = chunked(rows, ["entity_id"], "text", small).select(
        "entity_id", "chunk_index", "content_hash", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("p").alias("embedding_provider"), F.lit("m").alias("embedding_model"),
        F.lit(1).alias("embedding_dimensions"), F.lit("h").alias("embedding_hash"), F.lit(None).cast("string").alias("metadata"), *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("created_at", "updated_at")],
    )
    text = F.when(F.col("entity_id") % 3 == 0, F.concat("text", F.lit(" more"))).when(F.col("entity_id") % 5 == 0, F.substring("text", 1, 500)).otherwise(F.col("text"))
    longer = rows.withColumn("text", text)
    touched = rows.select("entity_id", ((F.col("entity_id") % 3 == 0) | (F.col("entity_id") % 5 == 0)).alias("is_changed"), (F.col("entity_id") % 15 == 0).alias("configuration_changed"))
    new = reconcile.new_chunks(chunked(longer, ["entity_id"], "text", small), stored, touched)
    return new.select("entity_id", "chunk_index", "content_hash", F.col("embedding").isNotNull().alias("kept"))


def _chunks_of(source: str, name: str) -> str:
    return rf"""
{name}_t AS (SELECT doc_id, regexp_replace(text, '^[ \n\r\t\x0B\x00]+|[ \n\r\t\x0B\x00]+$', '', 'g') AS t FROM ({source})),
{name}_k AS (SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN [] ELSE regexp_split_to_array(t, '{_BLANKS}') END AS tok FROM {name}_t),
{name}_s AS (SELECT doc_id, tok, unnest(range(0, 1 + greatest(0, CAST(ceil((len(tok) - 100) / 90.0) AS BIGINT)))) AS i FROM {name}_k WHERE len(tok) > 0),
{name} AS (SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(array_to_string(tok[i * 90 + 1 : i * 90 + 100], ' ')) AS h FROM {name}_s)"""


CARRY_OVER = f"""
WITH {_chunks_of("SELECT doc_id, text FROM documents", "old")},
{_chunks_of("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' more' WHEN doc_id % 5 = 0 THEN substring(text, 1, 500) ELSE text END AS text FROM documents", "new")}
SELECT doc_id AS entity_id, n.i AS chunk_index, n.h AS content_hash, coalesce(n.h = o.h AND doc_id % 15 <> 0, false) AS kept FROM new n LEFT JOIN old o USING (doc_id, i)"""


def dependency_delta(spark: SparkSession, d: str) -> DataFrame:
    """Stored dependencies without some and with stale ones become the desired ones; common rows keep created_at."""
    desired = dependencies(catalog(spark, d, "customer"), "customer").withColumn("entity_id", F.col("entity_id").cast("bigint"))
    old = F.lit("2024-01-01").cast("timestamp")
    stale = desired.where("entity_id % 5 = 0").withColumn("dependency_id", F.col("dependency_id") + 1000)
    stored = desired.where("entity_id % 4 <> 0").unionByName(stale).withColumn("created_at", old)
    touched = desired.select("entity_id").distinct().withColumn("is_changed", F.lit(True))
    new = reconcile.new_dependencies(desired, stored, touched, F.lit("2025-01-01").cast("timestamp"))
    return new.select("entity_id", "dependency_type", "dependency_id", F.year("created_at").alias("since"))


DEPENDENCY_DELTA = f"""
SELECT entity_id, dependency_type, dependency_id, CASE WHEN entity_id % 4 <> 0 THEN 2024 ELSE 2025 END AS since FROM ({DEPS_DESIRED}) WHERE entity_type = 'customer'"""


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    desired, stored = _generations(spark, d)
    want = dependencies(catalog(spark, d, "customer"), "customer")
    have = want.where("NOT (entity_id % 11 = 0 AND dependency_type = 'region')")
    return drifts.drift(desired, stored, want, have).select("entity_id", F.array_join("drift", "+").alias("drift"))


DRIFT_REPORT = """
SELECT * FROM (
  SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE concat_ws('+', CASE WHEN c_custkey % 7 = 0 THEN 'content' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'configuration' END, CASE WHEN c_custkey % 11 = 0 THEN 'dependencies' END) END AS drift FROM customer
  UNION ALL SELECT * FROM (VALUES (-1, 'orphaned'), (-2, 'orphaned'))) WHERE drift <> ''"""


def prune_keys(spark: SparkSession, d: str) -> DataFrame:
    return drifts.pruned_keys(_generations(spark, d)[1], table(spark, d, "customer"), "c_custkey")


def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return drifts.missing_keys(_generations(spark, d)[1], table(spark, d, "customer"), "c_custkey")


def orphan_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Stored dependencies whose document isn't there, by id."""
    stored = table(spark, d, "rag_dependencies").where("id IS NOT NULL AND document_id IS NOT NULL").select("id", F.col("document_id").alias("entity_id")).distinct()
    return drifts.orphan_dependencies(stored, table(spark, d, "rag_documents").select(F.col("id").alias("entity_id"))).select("id")


ORPHANS = "SELECT DISTINCT id FROM rag_dependencies WHERE id IS NOT NULL AND document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM rag_documents WHERE id IS NOT NULL)"


def verify_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a sample of 50 customers' documents has, and how many of them are distinct customers."""
    picked = drifts.sample(_generations(spark, d)[1].where("entity_id > 0"), 50, seed=1)
    return picked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("distinct_n"))


VERIFY_SAMPLE = "SELECT least(50, count(*)) AS n, least(50, count(*)) AS distinct_n FROM customer WHERE c_custkey % 10 <> 0"

# -- embedding, status -----------------------------------------------------


def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks of documents; those of every second document lack a vector and, where their text is still there, get one."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    own = CONFIG.with_(max_tokens=100, overlap=10, dimensions=8)
    fresh = cut_lineage(chunked(rows, ["entity_id"], "text", own))  # the texts are cut once
    stored = fresh.select(
        "entity_id", "chunk_index", F.when(F.col("entity_id") % 5 == 0, F.lit("moved")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("entity_id") % 2 == 1, F.array_repeat(F.lit(1.0).cast("float"), 8)).alias("embedding"), *[F.lit(None).cast("string").alias(c) for c in ("embedding_provider", "embedding_model")],
        F.lit(None).cast("int").alias("embedding_dimensions"), F.lit(None).cast("string").alias("embedding_hash"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    embedder = embeds.HashEmbedder()
    answers = cut_lineage(embeds.embedded(embeds.pending(stored, fresh), embedder, own))  # and the embedder is asked once
    after = embeds.with_vectors(stored, answers, embedder, own)
    return after.select("entity_id", "chunk_index", F.size("embedding").alias("width"), "embedding_hash")


EMBED_PENDING = f"""
WITH {_chunks_of("SELECT doc_id, text FROM documents", "c")}
SELECT doc_id AS entity_id, i AS chunk_index, CASE WHEN doc_id % 2 = 1 OR doc_id % 5 <> 0 THEN 8 END AS width,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN sha256('{{"contentHash":"' || h || '","dimensions":8,"model":"text-embedding-3-small","provider":"hash"}}') END AS embedding_hash FROM c"""


def flip_synced(spark: SparkSession, d: str) -> DataFrame:
    """Current documents set to synced where none of their stored chunks lacks a vector."""
    from marginalia.sources.tables import current_rows

    documents = current_rows(table(spark, d, "rag_documents"), "id", "version", "content_hash", "configuration_hash", "status").withColumnRenamed("id", "entity_id")
    chunks = table(spark, d, "rag_chunks").where("id IS NOT NULL").select(F.col("document_id").alias("entity_id"), "embedding")
    return reconcile.flipped(documents, chunks, documents.where("content_hash IS NOT NULL")).select("entity_id", "status")


FLIP_SYNCED = """
WITH docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM rag_documents WHERE id IS NOT NULL) WHERE rn = 1)
SELECT id AS entity_id, CASE WHEN content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rag_chunks c WHERE c.document_id = docs.id AND c.id IS NOT NULL AND c.embedding IS NULL) THEN 'synced' ELSE status END AS status FROM docs"""


def vector_widths(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors by width, and the widths that type names say."""
    rows = table(spark, d, "rag_chunks").where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("width")).agg(F.countDistinct("id").alias("chunks"))
    return rows.withColumn("declared", vector_width(F.concat(F.lit("VECTOR("), F.col("width").cast("string"), F.lit(")"))))


VECTOR_WIDTHS = "SELECT CAST(len(embedding) AS INTEGER) AS width, count(DISTINCT id) AS chunks, CAST(len(embedding) AS INTEGER) AS declared FROM rag_chunks WHERE embedding IS NOT NULL GROUP BY ALL"


def vector_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON and read back; those of another width than 64 are null."""
    rows = table(spark, d, "rag_chunks").where("id IS NOT NULL").select("id", F.to_json("embedding").alias("j"))
    return rows.select("id", parse_vector(F.col("j"), 64).isNotNull().alias("decoded")).distinct()


VECTOR_DECODE = "SELECT DISTINCT id, coalesce(len(embedding) = 64, false) AS decoded FROM rag_chunks WHERE id IS NOT NULL"

QUERIES = {
    "render_belongs_to": (render_belongs_to, RENDER_BELONGS_TO),
    "render_decimal": (render_decimal, RENDER_DECIMAL),
    "render_many_to_many": (render_many_to_many, RENDER_MANY_TO_MANY),
    "render_ordered": (render_ordered, RENDER_ORDERED),
    "render_nested_lists": (render_nested_lists, RENDER_NESTED),
    "canonical_values": (canonical_values, CANONICAL_VALUES),
    "config_hash": (config_hash, CONFIG_HASH),
    "provenance_hash": (provenance, PROVENANCE),
    "chunk_text": (chunk_text, CHUNK_TEXT),
    "chunk_counts": (chunk_counts, CHUNK_COUNTS),
    "chunk_vocabulary": (chunk_vocabulary, None),
    "search_topk": (search_topk, _search_sql(_EMBEDDINGS_SQL, "true", 5, "entity_id")),
    "search_scores": (search_scores, _search_sql(_EMBEDDINGS_SQL, "true", 5)),
    "search_vectorised": (search_vectorised, _search_sql(_EMBEDDINGS_SQL, "true", 5)),
    "search_min_similarity": (search_min_similarity, _search_sql(_EMBEDDINGS_SQL, _NEAR, 100)),
    "search_scoped": (search_scoped, _search_sql(_EMBEDDINGS_SQL, "entity_id % 2 = 0", 100)),
    "search_chunks": (search_chunks, _search_sql(_CHUNKS_SQL, "true", 20)),
    "search_hydrated": (
        search_hydrated,
        "SELECT CAST(place AS INTEGER) AS place, entity_id, n_name FROM (SELECT entity_id, row_number() OVER (ORDER BY distance, entity_id) AS place FROM ("
        + _search_sql(_EMBEDDINGS_SQL, "true", 8)
        + ")) JOIN nation ON n_nationkey = entity_id WHERE n_nationkey <> 3",
    ),
    "deps_desired": (deps_desired, DEPS_DESIRED),
    "fanout_pairs": (fanout_pairs, FANOUT_PAIRS),
    "fanout_batches": (fanout_batches, FANOUT_BATCHES),
    "fanout_stored": (fanout_stored, FANOUT_STORED),
    "throttle_events": (throttle_events, THROTTLE_EVENTS),
    "reconcile_actions": (reconcile_actions, RECONCILE_ACTIONS),
    "reconcile_documents": (reconcile_documents, RECONCILE_DOCUMENTS),
    "embedding_carry_over": (embedding_carry_over, CARRY_OVER),
    "dependency_delta": (dependency_delta, DEPENDENCY_DELTA),
    "drift_report": (drift_report, DRIFT_REPORT),
    "prune_keys": (prune_keys, "SELECT * FROM (VALUES (-1), (-2)) t(entity_id)"),
    "missing_keys": (missing_keys, "SELECT c_custkey AS entity_id FROM customer WHERE c_custkey % 10 = 0"),
    "orphan_dependencies": (orphan_dependencies, ORPHANS),
    "verify_sample": (verify_sample, VERIFY_SAMPLE),
    "embed_pending": (embed_pending, EMBED_PENDING),
    "flip_synced": (flip_synced, FLIP_SYNCED),
    "vector_widths": (vector_widths, VECTOR_WIDTHS),
    "vector_decode": (vector_decode, VECTOR_DECODE),
}
