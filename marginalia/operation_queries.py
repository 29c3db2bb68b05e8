"""Queries that run the index itself over the customers, with their SQL: a lifecycle, its reports, its feed.

The lifecycle is played once for a session and directory, and each query gives one of its results: all customers are
synced and embedded; then some are renamed, some lose their nation and some are gone (``_second``), they are
synced again, pruned, marked as failed and rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, check_chunking
from marginalia.functions.tokens import make_tokenizer
from marginalia.index import Index
from marginalia.index_queries import catalog
from marginalia.plans import invalidate
from marginalia.plans.search import validated_limit
from marginalia.runtime import cut_lineage, shared_dir
from marginalia.sources.tables import table
from marginalia.spec import DocumentSpec, EntityCatalog, Relation
from marginalia.streaming import feed

SIGNS = "abcdefghijklmnop0123456789"
QUESTION = "furniture of canada 4711 and a bid"
CONFIG = EngineConfig(max_tokens=4, overlap=1, dimensions=len(SIGNS), buckets=4, model="signs")


class SignEmbedder:
    """A text as the numbers of its letters and digits, which any engine counts alike."""

    provider = "signs"

    def embed(self, texts: list[str], model: str, dimensions: int) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in SIGNS[:dimensions]] for t in texts]


def _catalog(spark: SparkSession, d: str, second: bool) -> EntityCatalog:
    c = catalog(spark, d, "customer")
    if second:
        rows, key = c["customer"].rows, F.col("c_custkey")
        for column, value in (
            ("c_name", F.when(key % 11 != 0, F.col("c_name"))), ("c_nationkey", F.when(key % 11 != 0, F.col("c_nationkey"))),
            ("c_mktsegment", F.when(key % 7 == 0, F.concat("c_mktsegment", F.lit(" one two three four five"))).otherwise(F.col("c_mktsegment"))),
        ):
            rows = rows.withColumn(column, value)
        c["customer"].rows = rows.where(key % 13 != 0)
    return c


def _index(spark: SparkSession, d: str, root: str, second: bool = False, config: EngineConfig = CONFIG) -> Index:
    return Index(spark, root, _catalog(spark, d, second), config, SignEmbedder())


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _play(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    root, told = _root(spark, "lifecycle"), []

    def opened(second: bool) -> Index:
        ix = _index(spark, d, root, second)
        ix.listeners.append(lambda e: told.append((len(told), e.kind, e.entity_type, e.detail.get("count"))))
        return ix

    ix = opened(False)
    ix.sync("customer")
    ix.embed("customer")
    out["found"] = cut_lineage(ix.search_with_scores("customer", QUESTION, limit=5, with_text=True))
    out["clamped"] = cut_lineage(_index(spark, d, root, config=CONFIG.with_(max_limit=3)).search("customer", QUESTION, limit=50, min_similarity=0.0))
    out["affected"] = cut_lineage(ix.invalidate("region", [1, 1, 77]))
    ix.build_vector_index("customer", cells=16)
    ann = _index(spark, d, root, config=CONFIG.with_(search_mode="ann"))
    out["near"] = cut_lineage(ann.search_with_scores("customer", QUESTION, limit=5))
    ix = opened(True)
    ix.sync()
    out["documents"], out["chunks"], out["dependencies"] = (cut_lineage(ix.table(t)) for t in ("documents", "chunks", "dependencies"))
    out["doctor"] = spark.createDataFrame([(c, level) for c, level, _ in ix.doctor()], "check string, level string")
    out["pruned"] = spark.createDataFrame(list(ix.prune().items()), "entity_type string, documents bigint")
    status = ix.status()
    rows = [("rows", t, status[t]) for t in ("documents", "chunks", "dependencies")] + [(k, n, v) for k in ("by_status", "by_type") for n, v in status[k].items()]
    out["status"] = spark.createDataFrame(rows, "part string, name string, n bigint")
    out["types"] = spark.createDataFrame([(t,) for t in ix.entity_types()], "entity_type string")
    before = _index(spark, d, root)
    out["drift"] = cut_lineage(before.drift("customer").select("entity_id", F.array_join("drift", "+").alias("drift")))
    found = before.verify("customer")
    out["verify"] = spark.createDataFrame([(found["checked"], found["drifted"], found["orphaned"], len(found["report"]), found["more"], found["ok"])], "checked bigint, drifted bigint, orphaned bigint, shown bigint, more bigint, ok boolean")
    sampled = before.verify("customer", sample=20)
    out["sampled"] = spark.createDataFrame([(sampled["checked"], sampled["orphaned"])], "checked bigint, orphaned bigint")
    keys = table(spark, d, "customer").where("c_custkey % 17 = 0").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("broken "), F.col("c_custkey").cast("string")).alias("message"))
    ix.record_failure("customer", keys)
    out["failed"] = cut_lineage(ix.in_state("failed"))
    ix.rebuild()
    out["rebuilt"], out["rebuilt_chunks"] = cut_lineage(ix.table("documents")), cut_lineage(ix.table("chunks"))
    out["one"] = cut_lineage(ix.document("customer", 7).select("entity_id", "version"))
    out["its"] = cut_lineage(ix.dependencies_of("customer", 7).select("dependency_type", "dependency_id"))
    ix.forget("customer", table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id")))
    out["left"] = spark.createDataFrame([(t, ix.table(t).select("entity_id").distinct().count()) for t in ("documents", "chunks")], "name string, documents bigint")
    out["events"] = spark.createDataFrame(told, "place int, kind string, entity_type string, n bigint")
    return out


_PLAYED: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _result(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d)
        if key not in _PLAYED:
            _PLAYED.clear()
            _PLAYED[key] = _play(spark, d)
        out = _PLAYED[key][name]
        return out.selectExpr(*columns) if columns else out

    return query


_TEXT = r"""'c_name: ' || coalesce(c_name, '') || chr(10) || 'c_acctbal: ' || coalesce(regexp_replace(CAST(CAST(round(c_acctbal, 6) AS DECIMAL(38,6)) AS VARCHAR), '\.?0+$', ''), '') || chr(10)
  || 'c_mktsegment: ' || coalesce(c_mktsegment, '') || chr(10) || 'nation.n_name: ' || coalesce(n_name, '') || chr(10) || 'nation.region.r_name: ' || coalesce(r_name, '')"""


def _generation(name: str, source: str) -> str:
    return rf"""
{name}_t AS (SELECT c_custkey AS k, c_nationkey AS nation, n_regionkey AS region, {_TEXT} AS text FROM ({source}) LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
{name}_w AS (SELECT k, regexp_split_to_array(regexp_replace(text, '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g'), '[ \n\r\t]+') AS tok FROM {name}_t),
{name}_c AS (SELECT k, i, array_to_string(tok[i * 3 + 1 : i * 3 + 4], ' ') AS text FROM (SELECT k, tok, unnest(range(0, 1 + greatest(0, CAST(ceil((len(tok) - 4) / 3.0) AS BIGINT)))) AS i FROM {name}_w))"""


_SQL = f"""
WITH {_generation("a", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer")},
{_generation("b", '''SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS c_name, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' one two three four five' ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 13 <> 0''')},
now_t AS (SELECT * FROM b_t UNION ALL SELECT * FROM a_t WHERE k NOT IN (SELECT k FROM b_t)),
now_c AS (SELECT * FROM b_c UNION ALL SELECT * FROM a_c WHERE k NOT IN (SELECT k FROM b_t)),
now AS (SELECT n.*, n.text <> a.text AS changed FROM now_t n JOIN a_t a USING (k)),
deps AS (SELECT k, 'nation' AS dependency_type, CAST(nation AS BIGINT) AS dependency_id FROM now WHERE nation IS NOT NULL UNION ALL SELECT k, 'region', CAST(region AS BIGINT) FROM now WHERE region IS NOT NULL)
"""
_COUNTS = ", ".join(f"CAST(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')) AS DOUBLE)" for c in SIGNS)
_ASKED = "[" + ", ".join(f"{float(QUESTION.count(c))}::DOUBLE" for c in SIGNS) + "]"
_FOUND = f"""
, vec AS (SELECT k, i, text, [{_COUNTS.format("text")}] AS e FROM a_c),
dist AS (SELECT k, i, text, 1 - list_dot_product(e, {_ASKED}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_ASKED}, {_ASKED}))) AS dist FROM vec),
best AS (SELECT k, min(dist) AS dist, arg_min(i, (dist, i)) AS i, arg_min(text, (dist, i)) AS text FROM dist GROUP BY k),
placed AS (SELECT *, row_number() OVER (ORDER BY dist, k) AS place FROM best)
"""
_PENDING = "k % 13 <> 0"


def feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents after a feed: saved customers are synced, deleted ones forgotten, and a saved nation's customers synced with it."""
    root = _root(spark, "feed")
    _index(spark, d, root).sync("customer")
    ix = _index(spark, d, root, second=True)
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    at = lambda s: F.lit(f"2025-01-01 00:00:0{s}").cast("timestamp")
    saved = keys.where("entity_id % 7 = 0").select(F.lit("customer").alias("entity_type"), "entity_id", F.lit("updated").alias("op"), at(0).alias("at"))
    gone = keys.where("entity_id % 13 = 0").select(F.lit("customer").alias("entity_type"), "entity_id", F.lit("deleted").alias("op"), at(1).alias("at"))
    nation = spark.range(2).select(F.lit("nation").alias("entity_type"), F.lit(3).cast("bigint").alias("entity_id"), F.lit("updated").alias("op"), F.when(F.col("id") == 0, at(2)).otherwise(at(4)).alias("at"))
    feed.process(ix, saved.unionByName(gone).unionByName(nation))
    return ix.table("documents").select("entity_id", "content_hash")


FEED_DOCUMENTS = (
    _SQL
    + """SELECT a.k AS entity_id, sha256(CASE WHEN a.k % 7 = 0 OR a.nation = 3 THEN b.text ELSE a.text END) AS content_hash FROM a_t a JOIN b_t b USING (k)"""
)


def text_ids(spark: SparkSession, d: str) -> DataFrame:
    """Nations under text ids and what depends on a region of such an id."""
    c = EntityCatalog()
    c.register("region", table(spark, d, "region").withColumn("r_regionkey", F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))), "r_regionkey")
    nation = table(spark, d, "nation").withColumns({"n_nationkey": F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_regionkey": F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))})
    c.register("nation", nation, "n_nationkey", {"region": Relation("one", "region", local="n_regionkey")}, DocumentSpec(("n_name",), ("region.r_name",)))
    ix = Index(spark, _root(spark, "texts"), c, CONFIG.with_(id_type="string"))
    ix.sync("nation")
    return ix.affected("region", "r1")


TEXT_IDS = "SELECT 'nation' AS entity_type, 'n' || n_nationkey AS entity_id FROM nation WHERE n_regionkey = 1"


def bridges(spark: SparkSession, d: str) -> DataFrame:
    """What part 1 depends on after suppliers 1, 2 and 3 were attached and 2 was detached."""
    ix = Index(spark, _root(spark, "bridges"), catalog(spark, d, "part"), CONFIG)
    ix.attach("part", "suppliers", 1, [1, 2, 3])
    ix.detach("part", "suppliers", 1, [2])
    return ix.dependencies_of("part", 1).select("dependency_type", "dependency_id")


BRIDGES = """
SELECT DISTINCT 'supplier' AS dependency_type, s_suppkey AS dependency_id FROM supplier
WHERE s_suppkey <> 2 AND (s_suppkey IN (1, 3) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 1))"""


def validation(spark: SparkSession, d: str) -> DataFrame:
    """Which arguments are refused before anything is read or asked."""
    c = catalog(spark, d, "customer")
    cases: list[tuple[str, str, Callable[[], object]]] = [
        *[("chunk", f"{most}/{lap}", lambda most=most, lap=lap: check_chunking(most, lap)) for most, lap in ((4, 1), (1, 0), (4, 4), (4, 5), (0, 0), (4, -1))],
        *[("limit", f"{n}/{s}", lambda n=n, s=s: validated_limit(n, s, 1000)) for n, s in ((1, None), (5000, 0.0), (5, 1.0), (0, None), (-1, None), (5, -0.01), (5, 1.01))],
        *[("path", p, lambda p=p: c.validate("customer", p)) for p in ("nation.n_name", "nation.region.r_name", "c_name", "c_name.x", "naton.n_name", "nation.regon.r_name")],
        *[("reference", r, lambda r=r: invalidate.parse_reference(r)) for r in ("nation:1", "a:b:c", "nation", ":1", "nation:")],
        *[("tokenizer", t, lambda t=t: make_tokenizer(t)) for t in ("whitespace", "tiktoken", "no.such.Class", "builtins.dict")],
    ]

    def refused(call: Callable[[], object]) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(kind, argument, refused(call)) for kind, argument, call in cases], "kind string, argument string, refused boolean")


VALIDATION = """
SELECT * FROM (VALUES ('chunk', '4/1', false), ('chunk', '1/0', false), ('chunk', '4/4', true), ('chunk', '4/5', true), ('chunk', '0/0', true), ('chunk', '4/-1', true),
  ('limit', '1/None', false), ('limit', '5000/0.0', false), ('limit', '5/1.0', false), ('limit', '0/None', true), ('limit', '-1/None', true), ('limit', '5/-0.01', true), ('limit', '5/1.01', true),
  ('path', 'nation.n_name', false), ('path', 'nation.region.r_name', false), ('path', 'c_name', true), ('path', 'c_name.x', true), ('path', 'naton.n_name', true), ('path', 'nation.regon.r_name', true),
  ('reference', 'nation:1', false), ('reference', 'a:b:c', false), ('reference', 'nation', true), ('reference', ':1', true), ('reference', 'nation:', true),
  ('tokenizer', 'whitespace', false), ('tokenizer', 'tiktoken', true), ('tokenizer', 'no.such.Class', true), ('tokenizer', 'builtins.dict', true)) t(kind, argument, refused)"""

QUERIES = {
    "index_search": (
        _result("found", "CAST(place AS bigint) AS place", "entity_id", "round(distance, 6) AS distance", "round(score, 6) AS score", "CAST(chunk_index AS bigint) AS chunk_index", "chunk_text"),
        _SQL + _FOUND + "SELECT place, k AS entity_id, round(dist, 6) AS distance, round(1 - dist, 6) AS score, i AS chunk_index, text AS chunk_text FROM placed WHERE place <= 5",
    ),
    "index_search_clamped": (_result("clamped", "CAST(place AS bigint) AS place", "entity_id"), _SQL + _FOUND + "SELECT place, k AS entity_id FROM placed WHERE place <= 3"),
    "index_search_ann": (_result("near", "CAST(place AS bigint) AS place", "entity_id"), _SQL + _FOUND + "SELECT place, k AS entity_id FROM placed WHERE place <= 5"),
    "index_invalidate": (
        _result("affected", "entity_type", "entity_id", "batch_no"),
        _SQL + "SELECT 'customer' AS entity_type, k AS entity_id, (row_number() OVER (ORDER BY k) - 1) // 500 AS batch_no FROM a_t WHERE region = 1",
    ),
    "index_documents": (
        _result("documents", "entity_type", "entity_id", "version", "content_hash", "status"),
        _SQL + "SELECT 'customer' AS entity_type, k AS entity_id, 1 AS version, sha256(text) AS content_hash, CASE WHEN changed THEN 'pending' ELSE 'synced' END AS status FROM now",
    ),
    "index_chunks": (
        _result("chunks", "entity_id", "CAST(chunk_index AS bigint) AS chunk_index", "content_hash", "embedding IS NOT NULL AS kept"),
        _SQL + "SELECT n.k AS entity_id, n.i AS chunk_index, sha256(n.text) AS content_hash, coalesce(n.text = a.text, false) AS kept FROM now_c n LEFT JOIN a_c a USING (k, i)",
    ),
    "index_dependencies": (_result("dependencies", "entity_id", "dependency_type", "dependency_id"), _SQL + "SELECT k AS entity_id, dependency_type, dependency_id FROM deps"),
    "index_doctor": (
        _result("doctor"),
        """SELECT * FROM (VALUES ('capabilities', 'OK'), ('dimensions', 'OK'), ('embedder', 'OK'), ('search', 'OK'), ('vector index of customer', 'WARN'), ('orphan dependencies', 'OK'), ('pending documents', 'WARN'), ('failed documents', 'OK')) t("check", level)""",
    ),
    "index_prune": (_result("pruned"), "SELECT 'customer' AS entity_type, count(*) AS documents FROM customer WHERE c_custkey % 13 = 0"),
    "index_status": (
        _result("status"),
        _SQL
        + f""", d AS (SELECT * FROM now WHERE {_PENDING})
SELECT 'rows' AS part, 'documents' AS name, count(*) AS n FROM d UNION ALL SELECT 'rows', 'chunks', count(*) FROM b_c UNION ALL SELECT 'rows', 'dependencies', count(*) FROM deps WHERE {_PENDING}
UNION ALL SELECT 'by_status', CASE WHEN changed THEN 'pending' ELSE 'synced' END, count(*) FROM d GROUP BY changed UNION ALL SELECT 'by_type', 'customer', count(*) FROM d""",
    ),
    "index_types": (_result("types"), "SELECT 'customer' AS entity_type"),
    "index_drift": (
        _result("drift"),
        _SQL
        + """SELECT a.k AS entity_id, CASE WHEN a.k % 13 = 0 THEN 'missing' WHEN a.k % 11 = 0 AND a.nation IS NOT NULL THEN 'content+dependencies' ELSE 'content' END AS drift
FROM a_t a LEFT JOIN now n USING (k) WHERE a.k % 13 = 0 OR n.changed""",
    ),
    "index_verify": (
        _result("verify"),
        _SQL
        + """, v AS (SELECT CAST(count_if(k % 13 <> 0) AS BIGINT) AS checked, CAST(count_if(changed OR k % 13 = 0) AS BIGINT) AS drifted FROM now)
SELECT checked, drifted, CAST(0 AS BIGINT) AS orphaned, CAST(least(20, drifted) AS BIGINT) AS shown, CAST(greatest(0, drifted - 20) AS BIGINT) AS more, drifted = 0 AS ok FROM v""",
    ),
    "index_verify_sample": (_result("sampled"), "SELECT CAST(least(20, count(*)) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS orphaned FROM customer WHERE c_custkey % 13 <> 0"),
    "index_failed": (
        _result("failed", "entity_type", "entity_id", "last_error"),
        f"SELECT 'customer' AS entity_type, c_custkey AS entity_id, 'broken ' || c_custkey AS last_error FROM customer WHERE c_custkey % 17 = 0 AND {_PENDING.replace('k %', 'c_custkey %')}",
    ),
    "index_rebuilt": (
        _result("rebuilt", "entity_id", "version", "status", "last_error"),
        f"SELECT c_custkey AS entity_id, 2 AS version, 'pending' AS status, CAST(NULL AS VARCHAR) AS last_error FROM customer WHERE {_PENDING.replace('k %', 'c_custkey %')}",
    ),
    "index_rebuilt_chunks": (
        _result("rebuilt_chunks", "entity_id", "CAST(chunk_index AS bigint) AS chunk_index", "embedding IS NOT NULL AS kept"),
        _SQL + "SELECT n.k AS entity_id, n.i AS chunk_index, coalesce(n.text = a.text, false) AS kept FROM b_c n LEFT JOIN a_c a USING (k, i)",
    ),
    "index_document": (_result("one"), "SELECT c_custkey AS entity_id, 2 AS version FROM customer WHERE c_custkey = 7"),
    "index_dependencies_of": (_result("its"), _SQL + "SELECT dependency_type, dependency_id FROM deps WHERE k = 7"),
    "index_forget": (
        _result("left"),
        f"SELECT name, count(*) AS documents FROM customer, (VALUES ('documents'), ('chunks')) t(name) WHERE c_custkey % 2 = 1 AND {_PENDING.replace('k %', 'c_custkey %')} GROUP BY name",
    ),
    "index_events": (
        _result("events", "place", "kind", "entity_type", "n"),
        _SQL
        + """SELECT * FROM (SELECT 0 AS place, 'synced' AS kind, 'customer' AS entity_type, count(*) AS n FROM a_t UNION ALL SELECT 1, 'embedded', 'customer', count(*) FROM a_c
UNION ALL SELECT 2, 'synced', 'customer', count(*) FROM now WHERE changed UNION ALL SELECT 3, 'sync_failed', 'customer', NULL UNION ALL SELECT 4, 'synced', 'customer', count(*) FROM b_t)""",
    ),
    "feed_documents": (feed_documents, FEED_DOCUMENTS),
    "text_ids": (text_ids, TEXT_IDS),
    "bridges": (bridges, BRIDGES),
    "validation": (validation, VALIDATION),
}
