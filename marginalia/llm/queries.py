"""Queries of this subpackage over the tables of one directory, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, leakage, neighbours, pii, splitting
from marginalia.sources.tables import table

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "rag_chunks"), k=10, min_similarity=0.95)
    return near.select(F.least("id", "near").alias("chunk_a"), F.greatest("id", "near").alias("chunk_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 50, among all rows."""
    rows = table(spark, d, "rag_chunks")
    return neighbours.nearest(rows, k=10, queries=rows.where("id % 50 = 0"), shortlist=200)


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of p1_neighbours against comparing its queries with all rows: how many queries there are, and whether nine tenths of the neighbours are found."""
    rows = table(spark, d, "rag_chunks")
    exact = neighbours.brute_force(rows, rows.where("id % 50 = 0"), 10)
    found = p1_neighbours(spark, d).select("id", "near", F.lit(1).alias("hit"))
    both = exact.join(found, ["id", "near"], "left").agg(F.countDistinct("id").alias("queries"), F.count("hit").alias("hits"), F.count(F.lit(1)).alias("all"))
    return both.select("queries", (F.col("hits") >= 0.9 * F.col("all")).alias("recalled"))


_USABLE_SQL = """
WITH u AS (SELECT id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM rag_chunks
  WHERE id IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY id)"""
P1_FOUND_SQL = (
    _USABLE_SQL
    + """,
n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
near AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS place
  FROM n a JOIN n b ON a.id <> b.id AND list_dot_product(a.e, b.e) >= 0.95)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM near WHERE place <= 10"""
)
P1_RECALL_SQL = _USABLE_SQL + " SELECT count(*) AS queries, true AS recalled FROM u WHERE id % 50 = 0"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pieces compared from the front: every piece ends at the latest natural boundary in reach."""
    return splitting.split(table(spark, d, "rag_sources"), order=splitting.FIRST).select("document_id", "chunk_index", "content_hash")


def p6_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The cuts of least total cost over each text."""
    return splitting.split(table(spark, d, "rag_sources"), order=splitting.TOTAL)


_BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CLOSING = """"')\\]”’""".replace("'", "''")
#: Tokens with the white space behind each, boundaries as numbers of tokens before them, then piece by piece.
P6_FOUND_SQL = f"""
WITH RECURSIVE sources AS (SELECT DISTINCT document_id, content, max_tokens AS most, overlap_tokens AS lap FROM rag_sources WHERE content IS NOT NULL),
split AS (SELECT *, regexp_extract_all(content, '[^{_BLANK}]+') AS tok, regexp_extract_all(content, '[^{_BLANK}]+([{_BLANK}]*)', 1) AS gap FROM sources),
long AS (
  SELECT document_id, most, lap, tok, len(tok) AS n, list_filter(range(1, len(tok)), lambda i:
    regexp_matches(tok[i], '[.!?。][{_CLOSING}]*$') OR length(gap[i]) - length(replace(gap[i], chr(10), '')) >= 2) AS cuts
  FROM split WHERE len(tok) > most),
pieces AS (
  SELECT document_id, 0 AS k, CAST(0 AS BIGINT) AS a, coalesce(list_max(list_filter(cuts, lambda c: c > lap AND c <= most)), most) AS b FROM long
  UNION ALL
  SELECT p.document_id, k + 1, b - lap, CASE WHEN n - (b - lap) <= most THEN n ELSE coalesce(list_max(list_filter(cuts, lambda c: c > b AND c <= b - lap + most)), b - lap + most) END
  FROM pieces p JOIN long l ON l.document_id = p.document_id WHERE b < n)
SELECT document_id, CAST(k AS INTEGER) AS chunk_index, sha256(array_to_string(tok[a + 1 : b], ' ')) AS content_hash FROM pieces JOIN long USING (document_id)"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents within two edits of twelve words of an item, with the distance."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def _windows(source: str, key: str, text: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS g FROM (
    SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM {source}))"""


P8_FOUND_SQL = f"""
WITH d AS ({_windows("documents", "doc_id", "text")}), e AS ({_windows("eval_items", "item_id", "passage")})
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)"""


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "contacts"), table(spark, d, "brands")).select("doc_id", "pii_kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "contacts"), table(spark, d, "brands"))


QUERIES = {
    "p1_found": (p1_found, P1_FOUND_SQL),
    "p1_neighbours": (p1_neighbours, None),
    "p1_recall": (p1_recall, P1_RECALL_SQL),
    "p6_found": (p6_found, P6_FOUND_SQL),
    "p6_balanced": (p6_balanced, None),
    "p7_ids": (p7_ids, None),
    "p8_found": (p8_found, P8_FOUND_SQL),
    "p8_leaks": (p8_leaks, None),
    "p9_found": (p9_found, None),
    "p9_redacted": (p9_redacted, None),
}
