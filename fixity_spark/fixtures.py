"""Inventories, manifests and their companions derived from the generic test tables.

The SQL is in the common subset of Spark and DuckDB and runs unchanged on both. A file is a distinct
(l_orderkey, l_linenumber) of lineitem, a collection is a ship month, and locations are seven constants; faults
are planted by residues of a mixing column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fixity_spark.scratch import shuffle_buckets, work_folder

LOCATIONS = """
SELECT * FROM (VALUES
 (0,'HOT_A','hot',true,0,0,true,4000000000,200000000000),
 (1,'HOT_B','hot',true,0,0,true,90000000,200000000000),
 (2,'HOT_C','hot',false,0,0,true,50000000,60000000000),
 (3,'COLD_A','cold',true,1997,0,true,9000000000,900000000000),
 (4,'COLD_B','cold',true,0,0,true,9000000000,900000000000),
 (5,'COLD_OLD','cold',true,0,1996,true,9000000000,400000000000),
 (6,'COLD_OFF','cold',true,0,0,false,0,0))
 AS t(ord,name,role,pull,year_from,year_to,mounted,avail_bytes,total_bytes)
"""

#: View SQL by name, in order of dependence.
VIEWS = {
    "fx_locations": LOCATIONS,
    "fx_files": """
SELECT year, ym, lpad(CAST(m AS STRING),3,'0') || '_Shoot' AS slug,
 'CARD_' || CAST(k % 4 AS STRING) || '/' || CAST(k AS STRING) || '_' || CAST(ln AS STRING) || '.MXF' AS rel,
 size_bytes, (k*7919 + ln*104729) % 100003 AS h, d AS shot_at
FROM (
 SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS ln, max(l_shipdate) AS d,
  CAST(year(max(l_shipdate)) AS INT) AS year, CAST(month(max(l_shipdate)) AS INT) AS m,
  CAST(year(max(l_shipdate))*12 + month(max(l_shipdate)) AS INT) AS ym,
  CAST(round(max(l_extendedprice)*100) AS BIGINT) AS size_bytes
 FROM lineitem GROUP BY l_orderkey, l_linenumber) q
""",
    "fx_placed": """
SELECT f.*, l.ord, l.name AS location, l.role,
 CASE WHEN l.ord = 1 THEN NOT (f.ym % 4 = 0 AND f.h % 13 = 0)
      WHEN l.role = 'hot' THEN true
      ELSE NOT ((f.ym + l.ord) % 3 = 0 AND (f.h + l.ord*131) % 97 = 0) END AS on_disk
FROM fx_files f JOIN fx_locations l
 ON l.mounted AND (l.year_from = 0 OR f.year >= l.year_from) AND (l.year_to = 0 OR f.year <= l.year_to)
WHERE CASE WHEN l.ord = 2 THEN f.ym % 3 = 0 AND f.ym % 10 <> 9
           WHEN l.role = 'hot' THEN f.ym % 10 <> 9
           ELSE (f.ym + l.ord*5) % 11 <> 0 END
""",
    "fx_inventory": """
SELECT year, slug, location, ord, role, rel,
 CASE WHEN ord = 1 AND ym % 7 = 0 AND h % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes
FROM fx_placed WHERE on_disk
""",
    "fx_manifest": """
SELECT year, slug, location, ord, role, rel,
 CASE WHEN role = 'cold' AND (ym + ord) % 4 = 0 AND (h + ord*53) % 211 = 0 THEN md5(rel || '|bad' || CAST(ord AS STRING))
      ELSE md5(rel || '|' || CAST(size_bytes AS STRING)) END AS digest
FROM fx_placed
WHERE (on_disk AND NOT (ym % 5 = 0 AND h % 89 = ord)) OR (NOT on_disk AND h % 2 = 0)
""",
    "fx_counters": """
SELECT * FROM (VALUES (1995,12),(1996,3),(1997,20),(1998,12),(1999,0),(2000,11)) AS t(year,last_num)
""",
    "fx_content": """
SELECT doc_id, location, source || '/' || CAST(doc_id AS STRING) || '.txt' AS rel,
 CASE WHEN location = 'COLD_B' AND doc_id % 41 = 0 THEN text || 'x' ELSE text END AS text
FROM documents CROSS JOIN (VALUES ('COLD_A'),('COLD_B')) AS t(location)
WHERE NOT (location = 'COLD_B' AND doc_id % 53 = 7)
""",
    "fx_content_manifest": """
SELECT doc_id, location, source || '/' || CAST(doc_id AS STRING) || '.txt' AS rel,
 CASE WHEN location = 'COLD_A' AND doc_id % 37 = 0 THEN md5(text || '?') ELSE md5(text) END AS digest
FROM documents CROSS JOIN (VALUES ('COLD_A'),('COLD_B')) AS t(location)
WHERE doc_id % 29 <> 3
""",
    "fx_arrivals": """
SELECT 'CARD_' || CAST(user_id % 3 AS STRING) AS card,
 'Clip/C' || lpad(CAST(event_id AS STRING),7,'0') || '.MXF' AS rel,
 'C' || lpad(CAST(event_id AS STRING),7,'0') AS stem,
 CAST(round(value*1000) AS BIGINT) AS size_bytes, ts AS mtime
FROM events
""",
    "fx_sidecars": """
SELECT 'CARD_' || CAST(user_id % 3 AS STRING) AS card,
 'C' || lpad(CAST(event_id AS STRING),7,'0') || 'M01.XML' AS name,
 '<Meta><CreationDate value="' || CAST(CAST(CASE WHEN event_id % 30 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS DATE) AS STRING) || 'T00:00:00Z"/></Meta>' AS xml
FROM events WHERE event_id % 3 = 0
""",
    "fx_loose": """
SELECT location, year, rel, max(size_bytes) AS size_bytes, max(mtime) AS mtime FROM (
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'HOT_A' ELSE 'HOT_B' END AS location,
 CAST(year(o_orderdate) AS INT) AS year,
 'dir' || CAST(o_custkey % 3 AS STRING) || '/' ||
 CASE WHEN o_orderkey % 5 = 0 THEN 'DJI_' || y || m || d || '_' || CAST(o_orderkey % 7 AS STRING) || '.MP4'
      WHEN o_orderkey % 5 = 1 THEN 'IMG ' || y || '-' || m || '_' || d || ' ' || CAST(o_orderkey AS STRING) || '.JPG'
      WHEN o_orderkey % 5 = 2 THEN 'GH01' || CAST(o_orderkey AS STRING) || '.MP4'
      WHEN o_orderkey % 5 = 3 THEN 'X_' || y || '1399_' || CAST(o_orderkey AS STRING) || '.MOV'
      ELSE 'R9' || y || m || d || '_' || CAST(o_orderkey AS STRING) || '.WAV' END AS rel,
 CAST(round(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS mtime
FROM (SELECT *, lpad(CAST(year(o_orderdate) AS STRING),4,'0') AS y, lpad(CAST(month(o_orderdate) AS STRING),2,'0') AS m,
       lpad(CAST(day(o_orderdate) AS STRING),2,'0') AS d FROM orders) o) r
GROUP BY location, year, rel
""",
    "fx_raw_listing": """
SELECT location, rel, max(size_bytes) AS size_bytes FROM (
SELECT 'COLD_A' AS location, '2024/' || lpad(CAST(doc_id % 9 + 1 AS STRING),3,'0') || '_' || lang || '/' ||
 CASE WHEN doc_id % 17 = 0 THEN '@eaDir/' || CAST(doc_id AS STRING) || '.jpg'
      WHEN doc_id % 17 = 1 THEN 'CARD/Thumbs.db'
      WHEN doc_id % 17 = 2 THEN 'CARD/._' || CAST(doc_id AS STRING)
      WHEN doc_id % 17 = 3 THEN 'CARD/' || CAST(doc_id AS STRING) || '.MXF@SynoResource'
      WHEN doc_id % 17 = 4 THEN 'CARD/.hidden/' || CAST(doc_id AS STRING)
      WHEN doc_id % 17 = 5 THEN '@tmp/x/' || CAST(doc_id AS STRING)
      ELSE 'CARD/' || CAST(doc_id AS STRING) || '.MXF' END AS rel,
 n_chars AS size_bytes
FROM documents) r
GROUP BY location, rel
""",
}

# More views of the library's own, beside those of FIXTURES.md.
VIEWS |= {
    # the first archive covers fewer years than it holds, so that it is out of scope for some of its collections
    "fx_scopes": """
SELECT ord, name, role, pull, CASE WHEN name = 'COLD_A' THEN 1998 ELSE year_from END AS year_from, year_to, mounted, avail_bytes, total_bytes FROM fx_locations
""",
    # numbers with gaps, where new slugs meet old ones
    "fx_spaced": """
SELECT year, lpad(CAST(n * 3 - n % 2 AS STRING),3,'0') || '_Shoot' AS slug, location, ord, role, rel, size_bytes
FROM (SELECT *, CAST(split_part(slug,'_',1) AS INT) AS n FROM fx_inventory) i
""",
    "fx_spaced_manifest": """
SELECT year, lpad(CAST(n * 3 - n % 2 AS STRING),3,'0') || '_Shoot' AS slug, location, ord, role, rel, digest
FROM (SELECT *, CAST(split_part(slug,'_',1) AS INT) AS n FROM fx_manifest) m
""",
    # manifest lines that were verified: an archive was skipped in one year, and lines of one card in another
    "fx_verified": """
SELECT m.year, m.slug, m.location, m.rel, CASE WHEN i.size_bytes IS NULL THEN 'unreadable' WHEN md5(m.rel || '|' || CAST(i.size_bytes AS STRING)) = m.digest THEN 'ok' ELSE 'mismatch' END AS status
FROM fx_manifest m LEFT JOIN fx_inventory i ON i.year = m.year AND i.slug = m.slug AND i.location = m.location AND i.rel = m.rel
WHERE NOT (m.location = 'COLD_B' AND m.year = 1996) AND NOT (m.year = 1994 AND substring(m.rel, 1, 6) = 'CARD_2')
""",
    # names that meet: in several folders, with numbers already on them, with and without a date
    "fx_chained": """
SELECT DISTINCT 'HOT_A' AS location, CAST(1990 + o_orderkey % 7 AS INT) AS year,
 CASE WHEN o_orderkey % 4 = 0 THEN 'd' || CAST(o_custkey % 2 AS STRING) || '/' WHEN o_orderkey % 4 = 1 THEN 'q/d' || CAST(o_custkey % 2 AS STRING) || '_' WHEN o_orderkey % 4 = 2 THEN 'q_d0/' ELSE '' END ||
 CASE WHEN o_orderkey % 3 = 0 THEN '2001-05-' || lpad(CAST(o_orderkey % 9 + 1 AS STRING),2,'0') ELSE 'a' || CAST(o_orderkey % 5 AS STRING) END ||
 CASE WHEN o_orderkey % 11 < 4 THEN '_' || CAST(o_orderkey % 11 + 1 AS STRING) ELSE '' END || '.jpg' AS rel,
 CAST(1 AS BIGINT) AS size_bytes, CAST(NULL AS TIMESTAMP) AS mtime
FROM orders
""",
    # probe output: the time in the container, in a stream, or in neither
    "fx_probes": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"format":{"tags":{"creation_time":"' || t || '"}}}'
 WHEN event_id % 4 = 1 THEN '{"format":{"tags":{"other":"x"}},"streams":[{"tags":{"a":"b"}},{"tags":{"creation_time":"' || t || '"}}]}'
 WHEN event_id % 4 = 2 THEN '{"streams":[{}]}' ELSE 'no output' END AS output, 'A_' || CAST(event_id AS STRING) || '.MP4' AS rel, ts AS mtime
FROM (SELECT *, CAST(CAST(ts AS DATE) AS STRING) || 'T10:20:30Z' AS t FROM events) e
""",
}

#: fx_files as Spark reads it: the same rows, dealt by rel, which stands for the key of a file, before anything else is done
#: with them. Views over it put locations beside a file where it is, so whatever groups or joins their rows by path
#: finds them together already: one shuffle of one narrow row per file instead of one of each view's rows.
DEALT_FILES = """
SELECT year, ym, lpad(CAST(m AS STRING),3,'0') || '_Shoot' AS slug, rel, size_bytes, (k*7919 + ln*104729) % 100003 AS h, d AS shot_at
FROM (
 SELECT rel, k, ln, max(l_shipdate) AS d,
  CAST(year(max(l_shipdate)) AS INT) AS year, CAST(month(max(l_shipdate)) AS INT) AS m,
  CAST(year(max(l_shipdate))*12 + month(max(l_shipdate)) AS INT) AS ym,
  CAST(round(max(l_extendedprice)*100) AS BIGINT) AS size_bytes
 FROM (
  SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS ln, l_shipdate, l_extendedprice,
   'CARD_' || CAST(l_orderkey % 4 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.MXF' AS rel
  FROM lineitem DISTRIBUTE BY rel) dealt
 GROUP BY rel, k, ln) q
"""

#: Files that a task takes where files are dealt by their number (files_dealt).
FILES_PER_TASK = 200_000

TABLES = ("lineitem", "orders", "events", "documents")


def depends(name: str) -> list[str]:
    """The views that a view needs, itself last."""
    found: list[str] = []
    for other in re.findall(r"\bfx_\w+", VIEWS[name]):
        found += [x for x in depends(other) if x not in found]
    return [*found, name]


def oracle(sql: str, once: bool = True) -> str:
    """The query with the views it names in front, as DuckDB runs it: each view once, however often it is named."""
    needed: list[str] = []
    for name in re.findall(r"\bfx_\w+", sql):
        needed += [x for x in depends(name) if x not in needed]
    views = ",\n".join(f"{n} AS {'MATERIALIZED ' if once else ''}({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not needed:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


#: Views written by materialise: folder by (application, sf_dir, view).
_WRITTEN: dict[tuple[str, str, str], str] = {}


def materialise(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("fx_locations", "fx_inventory", "fx_manifest", "fx_verified", "fx_content", "fx_content_manifest", "fx_loose", "fx_spaced", "fx_spaced_manifest")) -> None:
    """Writes views once, for this application; queries read them from then on, so that timing them is not timing views."""
    app = spark.sparkContext.applicationId
    for name in names:
        folder = f"{work_folder(spark, name)}/rows"
        view(spark, sf_dir, name).write.parquet(folder)
        _WRITTEN[app, sf_dir, name] = folder


def files_dealt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """fx_files in so many parts that none has many more than FILES_PER_TASK rows, and the number of parts: what sorts the rows
    of a part, several for each file, then needs no more memory the more files there are."""
    parts = max(shuffle_buckets(spark), -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // FILES_PER_TASK))
    return view(spark, sf_dir, "fx_files", parts=parts), parts


def view(spark: SparkSession, sf_dir: str, name: str, files: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """A fixture view over the tables in sf_dir; over files, if these are given, instead of fx_files. Files are dealt to as
    many parts as shuffles have, or to parts."""
    if folder := _WRITTEN.get((spark.sparkContext.applicationId, sf_dir, name)):
        return spark.read.parquet(folder)
    if name == "fx_files" and files is not None:
        return files
    dealt = DEALT_FILES if parts is None else DEALT_FILES.replace("SELECT l_orderkey", f"SELECT /*+ REPARTITION({parts}, rel) */ l_orderkey").replace(" DISTRIBUTE BY rel", "")
    sql = oracle(f"SELECT * FROM {name}", once=False).replace(VIEWS["fx_files"], dealt if files is None else "SELECT * FROM given_files")
    tables = {} if files is None else {"given_files": files}
    tables |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **tables)
