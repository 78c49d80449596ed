"""Derived views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "papers_view": """
WITH tmpl(k, head_d, stmt_d, head_c, stmt_c) AS (VALUES
 (0,'Data availability:','All data are available at https://zenodo.org/record/{id} and archived under DOI 10.5281/zenodo.{id}.','Code availability:','Analysis code is available at https://github.com/lab/repo{id}.'),
 (1,'DATA ACCESSIBILITY','The data are available upon reasonable request from the corresponding author.','CODE AVAILABILITY','Scripts are available on request.'),
 (2,'Data accessibility:','Readings of all loggers count as open data, available from http://dx.doi.org/10.6084/m9.figshare.{id}[S2].','Software availability','The software is available at https://gitlab.com/lab/p{id}, see also https://orcid.org/0000-0001.'),
 (3,'Data availability','All datasets will be made available upon publication.','Acknowledgements','Data of others are at https://zenodo.org/record/9{id}, their code is at https://github.com/other/x{id}.'),
 (4,'Data availability','All data are provided in the article and in the supplementary materials.','Code availability','Code is available at https://github.com/a/b{id}https://github.com/c/d{id}'),
 (5,'Introduction','Nothing relevant is stated here.','Methods','Samples were counted twice. All data were shared by https://zenodo.org/record/7{id}?a= b.
References
Nobody (1999), doi:10.9999/late.{id}'),
 (6,'Data availability','Data are available at https://zenod o.org/record/{id}.','Code availability','Code available at www.bitbucket.org/lab/{id}.'),
 (7,'Data availability:','','Code availability:',''))
SELECT d.doc_id, b.seq, CASE WHEN b.seq < 4 THEN 1 ELSE 2 END AS page, CASE WHEN b.seq IN (3, 6, 7) THEN 1 ELSE 0 END AS col, CAST(d.doc_id % 8 AS INT) AS k,
 replace(CASE b.seq
   WHEN 0 THEN CASE WHEN t.k = 1 THEN 'Molecular Ecology (2000) 9, 1319-1324' ELSE 'Research Article:' END
   WHEN 1 THEN 'Seasonal Patterns in ' || upper(d.lang) || ' Records from Station {id}'
   WHEN 2 THEN CASE t.k WHEN 0 THEN 'doi:10.1234/ref.{id}' WHEN 1 THEN 'https://doi.org/10.2345/ref.{id}'
        WHEN 2 THEN 'Early mention 10.2222/other.{id} then doi:10.1111/chosen.{id}' WHEN 3 THEN 'Archived as 10.5281/zenodo.{id}'
        WHEN 4 THEN 'See 10.3456/ref.{id}(table 2).' ELSE 'No identifier given' END
   WHEN 3 THEN d.text
   WHEN 4 THEN t.head_d WHEN 5 THEN t.stmt_d WHEN 6 THEN t.head_c ELSE t.stmt_c END,
  '{id}', CAST(d.doc_id AS STRING)) AS text
FROM documents d JOIN tmpl t ON t.k = d.doc_id % 8
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS b(seq)""",
    "jobs_view": """
SELECT o_orderkey AS job_id, o_custkey AS user_id,
 CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') THEN 'running'
      WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'error' END AS status,
 o_orderdate AS created_at,
 CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '1' HOUR END AS started_at,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' HOUR + INTERVAL '1' SECOND * (o_custkey % 600) END AS finished_at,
 CASE WHEN o_orderstatus = 'P' THEN 'Cancelled by user' END AS error
FROM orders""",
    "docs_view": """
SELECT l_orderkey AS job_id,
 CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS doc_id,
 'dir/paper_' || CAST(l_partkey AS STRING) || CASE WHEN l_suppkey % 7 = 0 THEN '.txt' ELSE '.PDF' END AS filename,
 CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_shipdate AS created_at,
 CASE l_returnflag WHEN 'R' THEN 'done' WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'error' ELSE 'done' END
   ELSE CASE l_linestatus WHEN 'O' THEN 'queued' ELSE 'processing' END END AS status,
 CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'Title ' || CAST(l_partkey AS STRING) END AS title,
 CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE '10.1234/p.' || CAST(l_partkey AS STRING) END AS doi,
 CAST(l_linenumber % 3 AS INT) AS n_data_links, CAST(l_suppkey % 2 AS INT) AS n_code_links,
 1.0 - l_discount AS confidence,
 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Failed on page ' || CAST(l_linenumber AS STRING) END AS error
FROM lineitem""",
    "logs_view": """
SELECT event_id AS log_id, user_id AS job_id, ts, event_type AS op,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
 CAST(floor(value * 100) AS BIGINT) AS duration_ms, props AS extra
FROM events""",
    "registry_view": """
SELECT CASE doc_id % 8 WHEN 0 THEN '10.1234/ref.' WHEN 1 THEN '10.2345/ref.' WHEN 2 THEN '10.1111/chosen.' ELSE '10.3456/ref.' END || CAST(doc_id AS STRING) AS doi,
 CASE WHEN doc_id % 3 = 0 THEN 'Unrelated Title About Rocks' ELSE 'Seasonal Patterns in ' || upper(lang) || ' Records from Station ' || CAST(doc_id AS STRING) END AS title,
 CAST(1990 + doc_id % 30 AS INT) AS issued_year,
 CASE WHEN doc_id % 2 = 0 THEN 'crossref' ELSE 'openalex' END AS source
FROM documents""",
    "runs_view": """
SELECT doc_id % 25 AS job_id, doc_id, CASE WHEN doc_id % 13 <> 0 THEN 'dir/paper_' || CAST(doc_id AS STRING) || '.pdf' END AS filename,
 CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 11 = 0 THEN 'queued' ELSE 'done' END AS status,
 CASE WHEN doc_id % 7 = 0 THEN 'Failed on page 1' END AS error
FROM documents""",
    "words_view": """
SELECT CAST(floor(l_orderkey / 50) AS INT) AS page_id, CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS word_id,
 CAST((l_partkey % 25) * 10 + CASE WHEN l_orderkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 340 ELSE 0 END AS DOUBLE) AS x0,
 CAST((l_partkey % 25) * 10 + 8 + CASE WHEN l_orderkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 340 ELSE 0 END AS DOUBLE) AS x1,
 CAST(l_linenumber * 14 + CASE WHEN l_linenumber > 4 THEN 20 ELSE 0 END AS DOUBLE) AS top,
 CAST(l_linenumber * 14 + 10 + CASE WHEN l_linenumber > 4 THEN 20 ELSE 0 END AS DOUBLE) AS bottom,
 CAST(600 AS DOUBLE) AS page_width,
 CASE WHEN l_suppkey % 9 = 0 THEN ' ' WHEN l_suppkey % 9 = 1 THEN 'Data:' ELSE ' w' || CAST(l_partkey AS STRING) || ' ' END AS text
FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; the tables it reads have names of their own for this call, so views of the caller stay as they are."""
    sql, mark, made = VIEWS[name], uuid.uuid4().hex, []
    for t in TABLES:
        named = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {t}_{mark}", sql)
        if named != sql:
            table(spark, sf_dir, t).createOrReplaceTempView(f"{t}_{mark}")
            sql, made = named, [*made, f"{t}_{mark}"]
    try:
        return spark.sql(sql)
    finally:
        for t in made:
            spark.catalog.dropTempView(t)


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names put before it."""
    needed = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in sql]
    sql = sql.strip()
    if not needed:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(needed) + ",\n" + sql[len("WITH RECURSIVE ") :]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(needed) + ",\n" + sql[len("WITH ") :]
    return "WITH " + ",\n".join(needed) + "\n" + sql
