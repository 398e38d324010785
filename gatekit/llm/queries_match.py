"""Queries that compare texts: near-duplicates, repeated paragraphs, benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .decontam import PERCENT as LEAK_PERCENT
from .decontam import leaks
from .near_dup import PERCENT, near_duplicates
from .paragraphs import repeated_passages
from .queries import query

NEAR_SQL = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), sh AS (
        SELECT DISTINCT doc_id, sg FROM (
            SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS sg FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.sg = b.sg AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
    ), reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ), roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _shingles_sql(table_name: str, key: str) -> str:
    """Distinct five-word shingles of a table's texts, or the whole text where it is shorter."""
    return f"""
        SELECT DISTINCT {key}, sg FROM (
            SELECT {key}, array_to_string(ws[i:i + 4], ' ') AS sg FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 3)) AS i FROM {table_name})
            UNION ALL SELECT {key}, 'whole: ' || array_to_string(ws, ' ') FROM {table_name} WHERE len(ws) BETWEEN 1 AND 4)"""


def _words_sql(source: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}"


LEAKS_SQL = f"""
    WITH d AS ({_words_sql("documents", "doc_id")}), i AS ({_words_sql("benchmark", "item_id")}),
    ds AS ({_shingles_sql("d", "doc_id")}), items AS ({_shingles_sql("i", "item_id")}),
    sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
    hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN items USING (sg) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM hits JOIN sizes USING (item_id) WHERE 100 * n_shared >= {LEAK_PERCENT} * n_item
"""


@query("op9_benchmark_leaks", LEAKS_SQL)
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op7_near_duplicates", NEAR_SQL)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_repeated_passages")
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tp")
