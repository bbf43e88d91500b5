"""Registered queries over the fixture views, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixity_spark.fixtures import files_dealt, oracle, view
from fixity_spark.functions import dates, paths, values
from fixity_spark.operators import diff, fixity, locations, numbering, reporting, selection
from fixity_spark.plans import check, ingest, manifests, organise, retain, transfer
from fixity_spark.schema import COLLECTION, KEY
from fixity_spark.scratch import joined_where_dealt, work_folder, written_dealt
from fixity_spark.sources import io
from fixity_spark.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The SQL as given, without the views in front.
GIVEN: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        GIVEN[f.__name__], ORACLES[f.__name__] = sql, oracle(sql)
        return f

    return register


class Tables:
    """Fixture views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, dealt: bool = False, sized: bool = False):
        """With dealt, the files are written once, dealt by path: for queries that run several jobs over their views. With sized,
        too, but to more parts the more files there are."""
        self.spark, self.sf_dir = spark, sf_dir
        files, self.parts = files_dealt(spark, sf_dir) if sized else (view(spark, sf_dir, "fx_files") if dealt else None, None)
        self._files = written_dealt(files, "files", ["rel"], self.parts) if files is not None else None

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}", self._files)

    def over(self, files: DataFrame) -> Tables:
        """The same views over files that are dealt in another way."""
        other = Tables(self.spark, self.sf_dir)
        other._files = files
        return other

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")


# ---- differences


def _only_at(one: str, other: str) -> str:
    return f"SELECT year, slug, rel, max(size_bytes) AS size_bytes FROM fx_inventory WHERE location IN ('{one}', '{other}') GROUP BY year, slug, rel HAVING count(*) FILTER (location = '{other}') = 0"


@query(_only_at("HOT_A", "COLD_B"))
def missing_files(spark, sf_dir):
    inv = Tables(spark, sf_dir).inventory
    return diff.missing(diff.at(inv, "HOT_A"), diff.at(inv, "COLD_B")).select(*KEY, "size_bytes")


@query(_only_at("COLD_B", "HOT_A"))
def extra_files(spark, sf_dir):
    inv = Tables(spark, sf_dir).inventory
    return diff.extra(diff.at(inv, "HOT_A"), diff.at(inv, "COLD_B")).select(*KEY, "size_bytes")


@query("SELECT year, slug, location, rel FROM fx_manifest m ANTI JOIN fx_inventory i USING (year, slug, location, rel)")
def ghost_entries(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return diff.ghosts(t.inventory, t.manifest).select(*COLLECTION, "location", "rel")


@query("SELECT year, slug, rel, ref_digest, location, digest AS other_digest FROM (SELECT *, max(digest) FILTER (location = 'HOT_A') OVER (PARTITION BY year, slug, rel) AS ref_digest FROM fx_manifest) WHERE role = 'cold' AND digest <> ref_digest")
def digest_conflicts(spark, sf_dir):
    man = Tables(spark, sf_dir).manifest
    return diff.manifest_conflicts(diff.at(man, "HOT_A"), man.where("role = 'cold'"))


COVERED = "SELECT i.year, i.slug, i.location, i.ord, i.size_bytes, m.digest FROM fx_inventory i LEFT JOIN fx_manifest m USING (year, slug, location, rel)"


@query(f"SELECT year, slug, location, count(*) AS files, count(*) - count(digest) AS uncovered, count(*) = count(digest) AS covered FROM ({COVERED}) GROUP BY ALL")
def coverage_state(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return diff.coverage(t.inventory, t.manifest)


@query("""SELECT year, slug, count(*) AS n_diff FROM (
  (SELECT year, slug, rel, size_bytes FROM fx_inventory WHERE location = 'HOT_A' EXCEPT SELECT year, slug, rel, size_bytes FROM fx_inventory WHERE location = 'HOT_B')
  UNION ALL (SELECT year, slug, rel, size_bytes FROM fx_inventory WHERE location = 'HOT_B' EXCEPT SELECT year, slug, rel, size_bytes FROM fx_inventory WHERE location = 'HOT_A')) GROUP BY ALL""")
def listing_diff_hot(spark, sf_dir):
    inv = Tables(spark, sf_dir).inventory
    return diff.listing_diff(diff.at(inv, "HOT_A"), diff.at(inv, "HOT_B"))


@query("SELECT DISTINCT a.year, a.slug, a.rel FROM fx_manifest a JOIN fx_manifest b USING (year, slug, rel) WHERE a.location = 'HOT_A' AND b.location = 'COLD_B'")
def shared_manifest_paths(spark, sf_dir):
    man = Tables(spark, sf_dir).manifest
    return diff.shared_paths(diff.at(man, "HOT_A"), diff.at(man, "COLD_B"))


@query("SELECT year, slug, rel, arg_min(size_bytes, ord) AS size_bytes, arg_min(location, ord) AS location FROM fx_inventory GROUP BY ALL")
def union_listing(spark, sf_dir):
    return diff.union_listing(Tables(spark, sf_dir).inventory)


# ---- checks

COPIES = "SELECT year, slug, location, ord, role, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM fx_inventory GROUP BY ALL"
COVERS = "(l.year_from = 0 OR {y} >= l.year_from) AND (l.year_to = 0 OR {y} <= l.year_to)"


def _reference_sql(loc: str) -> str:
    """The first hot copy, else the first of the archives in scope; none where only others hold the collection."""
    return f"""SELECT year, slug, location AS ref, role AS ref_role FROM (SELECT c.* FROM ({COPIES}) c JOIN {loc} l ON l.name = c.location WHERE c.role = 'hot' OR ({COVERS.format(y='c.year')}))
QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY CASE role WHEN 'hot' THEN 0 ELSE 1 END, ord) = 1"""


def _check_sql(loc: str) -> str:
    """CTEs ref, pairs (with held: whether dst has the collection) and found (all findings)."""
    return f"""WITH ref AS MATERIALIZED ({_reference_sql(loc)}), has AS MATERIALIZED (SELECT DISTINCT year, slug, location FROM fx_inventory),
pairs AS MATERIALIZED (SELECT r.year, r.slug, r.ref, l.name AS dst, h.location IS NOT NULL AS held FROM ref r JOIN {loc} l ON l.mounted AND l.role = 'cold' AND {COVERS.format(y='r.year')} AND l.name <> r.ref LEFT JOIN has h ON h.year = r.year AND h.slug = r.slug AND h.location = l.name),
files AS (SELECT p.year, p.slug, p.dst, i.rel, max(i.size_bytes) FILTER (i.location = p.ref) AS a, max(i.size_bytes) FILTER (i.location = p.dst) AS b FROM pairs p JOIN fx_inventory i ON i.year = p.year AND i.slug = p.slug WHERE held AND i.location IN (p.ref, p.dst) GROUP BY ALL),
lines AS (SELECT p.year, p.slug, p.dst, m.rel, max(m.digest) FILTER (m.location = p.ref) AS a, max(m.digest) FILTER (m.location = p.dst) AS b FROM pairs p JOIN fx_manifest m ON m.year = p.year AND m.slug = p.slug WHERE m.location IN (p.ref, p.dst) GROUP BY ALL),
ghost AS (SELECT m.* FROM fx_manifest m ANTI JOIN fx_inventory i USING (year, slug, location, rel)),
found AS (SELECT year, slug, dst AS location, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a <> b THEN 'size_diff' END AS kind, rel, NULL AS ref_digest, NULL AS other_digest FROM files
 UNION ALL SELECT g.year, g.slug, location, 'ghost', rel, NULL, NULL FROM ghost g SEMI JOIN (SELECT year, slug, ref AS location FROM ref UNION SELECT year, slug, dst FROM pairs) USING (year, slug, location)
 UNION ALL SELECT year, slug, dst, 'conflict', rel, a, b FROM lines WHERE a <> b
 UNION ALL SELECT year, slug, dst, 'collection_missing', NULL, NULL, NULL FROM pairs WHERE NOT held
 UNION ALL SELECT year, slug, ref, 'only_copy', NULL, NULL, NULL FROM ref ANTI JOIN pairs USING (year, slug) WHERE ref_role = 'cold')"""


def _summary_sql(loc: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in reporting.KINDS)
    return f"{_check_sql(loc)} SELECT year, slug, {counts}, count(kind) = 0 AS passed FROM ref LEFT JOIN (SELECT * FROM found WHERE kind IS NOT NULL) USING (year, slug) GROUP BY ALL"


REFERENCE = _reference_sql("fx_locations")
PAIRS = f"SELECT r.year, r.slug, r.ref, l.name AS dst FROM ({REFERENCE}) r JOIN fx_locations l ON l.mounted AND l.role = 'cold' AND {COVERS.format(y='r.year')} AND l.name <> r.ref"
HELD_PAIRS = f"SELECT p.* FROM ({PAIRS}) p SEMI JOIN fx_inventory i ON i.year = p.year AND i.slug = p.slug AND i.location = p.dst"


@query(f"SELECT year, slug, ref AS location FROM ({REFERENCE})")
def reference_copy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.pick_reference(selection.copies(t.inventory), t.locations).select(*COLLECTION, "location")


@query(f"SELECT year, slug, ref AS location FROM ({_reference_sql('fx_scopes')})")
def reference_copy_scoped(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.pick_reference(selection.copies(t.inventory), t.scopes).select(*COLLECTION, "location")


@query(f"""SELECT p.year, p.slug, p.dst AS location, count(*) AS n_missing FROM ({PAIRS}) p JOIN fx_inventory i ON i.year = p.year AND i.slug = p.slug AND i.location = p.ref
  ANTI JOIN fx_inventory d ON d.year = p.year AND d.slug = p.slug AND d.location = p.dst AND d.rel = i.rel GROUP BY ALL""")
def missing_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return check.missing_summary(t.inventory, t.locations)


@query(_summary_sql("fx_locations"))
def check_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return check.check(t.inventory, t.manifest, t.locations)[1]


@query(_summary_sql("fx_scopes"))
def check_summary_scoped(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return check.check(t.inventory, t.manifest, t.scopes)[1]


@query(f"{_check_sql('fx_locations')} SELECT * FROM found WHERE kind IS NOT NULL")
def check_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return check.findings(t.inventory, t.manifest, t.locations)


@query(f"""WITH per AS (SELECT year, slug, count(*) AS n_scope FROM ({PAIRS}) GROUP BY ALL), held AS (SELECT year, slug, count(*) AS n_held FROM ({HELD_PAIRS}) GROUP BY ALL),
j AS (SELECT year, slug, ref, coalesce(n_scope, 0) AS n_scope, coalesce(n_held, 0) AS n_held FROM ({REFERENCE}) LEFT JOIN per USING (year, slug) LEFT JOIN held USING (year, slug))
SELECT year, slug, ref, CASE WHEN n_scope = 0 THEN 'no_destination' WHEN n_held = 0 THEN 'only_copy' ELSE 'collection_missing' END AS kind, n_scope, n_held FROM j WHERE n_held < n_scope OR n_scope = 0""")
def only_copy_collections(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return check.only_copies(t.inventory, t.locations)


# ---- reports

SCAN = f"SELECT year, slug, location, ord, sum(size_bytes)::BIGINT AS bytes, count(*) AS files, count(*) = count(digest) AS checksummed FROM ({COVERED}) GROUP BY ALL"
SIZES = f"SELECT year, slug, arg_min(bytes, ord) AS bytes FROM ({SCAN}) GROUP BY ALL"


def _scan(t: Tables) -> DataFrame:
    return reporting.collection_scan(t.inventory, t.manifest)


@query(SCAN)
def collection_scan(spark, sf_dir):
    return _scan(Tables(spark, sf_dir))


@query(SIZES)
def collection_size(spark, sf_dir):
    return reporting.collection_size(_scan(Tables(spark, sf_dir)))


@query(f"SELECT year, slug, sum(bytes)::BIGINT AS bytes, count(*) AS collections, grouping_id(year, slug)::INT AS level FROM ({SIZES}) GROUP BY ROLLUP (year, slug)")
def catalogue_totals(spark, sf_dir):
    return reporting.catalogue_totals(reporting.collection_size(_scan(Tables(spark, sf_dir))))


_CELL = ", ".join(f"coalesce(max(CASE WHEN location = '{n}' THEN CASE WHEN checksummed THEN 'checksummed' ELSE 'present' END END), '{'unknown' if n == 'COLD_OFF' else 'absent'}') AS \"{n}\"" for n in ("HOT_A", "HOT_B", "HOT_C", "COLD_A", "COLD_B", "COLD_OLD", "COLD_OFF"))


@query(f"SELECT year, slug, {_CELL} FROM ({SCAN}) GROUP BY ALL")
def presence_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.presence_matrix(_scan(t), t.locations)


@query("SELECT DISTINCT year FROM fx_inventory ORDER BY year DESC")
def years_present(spark, sf_dir):
    return reporting.years(Tables(spark, sf_dir).inventory)


@query("SELECT year, max(CAST(split_part(slug, '_', 1) AS INT)) AS max_num FROM fx_inventory GROUP BY ALL")
def max_numbers(spark, sf_dir):
    return reporting.max_number(Tables(spark, sf_dir).inventory)


def _size_sql(x: str) -> str:
    units = "KMGTPE"
    steps = " ".join(f"WHEN {x} >= {1024**k} THEN printf('%.1f{units[k - 1]}B', {x} / {float(1024**k)})" for k in range(5, 0, -1))
    return f"CASE {steps} ELSE printf('%dB', {x}) END"


@query(f"SELECT year, slug, {_size_sql('bytes')} AS size FROM ({SIZES})")
def human_size(spark, sf_dir):
    sizes = reporting.collection_size(_scan(Tables(spark, sf_dir)))
    return sizes.select(*COLLECTION, values.fmt_size(F.col("bytes")).alias("size"))


@query(f"SELECT c.year, c.slug, l.name AS dst, l.ord AS dst_ord FROM (SELECT DISTINCT year, slug FROM fx_inventory) c JOIN fx_locations l ON l.mounted AND l.role = 'cold' AND {COVERS.format(y='c.year')}")
def location_scope(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return locations.scope(reporting.collections(t.inventory), t.locations)


@query("""SELECT l.ord, l.name, l.role, coalesce(u.b, 0)::BIGINT AS used_bytes, l.total_bytes, least(1.0, coalesce(u.b, 0) / l.total_bytes::DOUBLE)::DOUBLE AS used_ratio
FROM fx_locations l LEFT JOIN (SELECT location, sum(size_bytes)::BIGINT AS b FROM fx_inventory GROUP BY ALL) u ON u.location = l.name WHERE l.mounted""")
def location_utilisation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    held = t.inventory.groupBy(F.col("location").alias("name")).agg(F.sum("size_bytes").alias("held"))
    loc = t.locations.join(held, "name", "left").withColumn("avail_bytes", F.col("total_bytes") - F.coalesce("held", F.lit(0)))
    return locations.utilisation(loc)


@query("SELECT year, slug, location, rel, size_bytes, rank, greatest(n - 4, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY year, slug, location ORDER BY rel)::INT AS rank, count(*) OVER (PARTITION BY year, slug, location) AS n FROM fx_inventory) WHERE rank <= 4")
def sample_files(spark, sf_dir):
    inv = Tables(spark, sf_dir).inventory.select(*COLLECTION, "location", "rel", "size_bytes")
    return reporting.sample_per_group(inv, [*COLLECTION, "location"], ["rel"])


# ---- transfer plans

HOT_DIFF = """SELECT year, slug, count(*) AS n_diff FROM (SELECT year, slug, rel, size_bytes, count(*) AS n FROM fx_inventory WHERE role = 'hot' GROUP BY ALL)
JOIN (SELECT year, slug, count(DISTINCT location) AS n_hot FROM fx_inventory WHERE role = 'hot' GROUP BY ALL) USING (year, slug) WHERE n < n_hot GROUP BY ALL"""
AGREED = f"SELECT * FROM ({COPIES}) c WHERE role = 'hot' AND NOT EXISTS (SELECT 1 FROM ({HOT_DIFF}) d WHERE d.year = c.year AND d.slug = c.slug) QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY ord) = 1"


def _plan_sql(sources: str, where: str) -> str:
    return f"""SELECT s.year, s.slug, s.location AS src, l.name AS dst, i.rel, i.size_bytes FROM ({sources}) s JOIN fx_locations l ON l.mounted AND l.name <> s.location AND {where}
JOIN fx_inventory i ON i.year = s.year AND i.slug = s.slug AND i.location = s.location
ANTI JOIN fx_inventory d ON d.year = s.year AND d.slug = s.slug AND d.location = l.name AND d.rel = i.rel"""


_IN_SCOPE = f"l.role = 'cold' AND {COVERS.format(y='s.year')}"
SYNC = _plan_sql(AGREED, _IN_SCOPE)
FULLEST = f"SELECT * FROM ({COPIES}) WHERE role = '{{role}}' QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY n_files DESC, ord) = 1"
PULL = _plan_sql(FULLEST.format(role="cold"), "l.role = 'hot' AND coalesce(l.pull, true)")


@query(f"SELECT year, slug, location FROM ({AGREED})")
def agreed_sources(spark, sf_dir):
    return selection.pick_agreed(Tables(spark, sf_dir).inventory).select(*COLLECTION, "location")


@query(SYNC)
def sync_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return transfer.sync_plan(t.inventory, t.locations)


@query(HOT_DIFF)
def sync_conflicts(spark, sf_dir):
    return transfer.sync_conflicts(Tables(spark, sf_dir).inventory)


@query(_plan_sql(f"SELECT * FROM ({COPIES}) c WHERE role = 'cold' AND (SELECT count(*) FROM fx_locations l WHERE l.mounted AND l.role = 'cold' AND {COVERS.format(y='c.year')}) > 1 QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY ord) = 1", _IN_SCOPE))
def replicate_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return transfer.replicate_plan(t.inventory, t.locations)


@query(f"SELECT year, slug, location, n_files FROM ({FULLEST.format(role='cold')})")
def fullest_source(spark, sf_dir):
    return selection.pick_fullest(selection.copies(Tables(spark, sf_dir).inventory), "cold").select(*COLLECTION, "location", "n_files")


@query(PULL)
def pull_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return transfer.pull_plan(t.inventory, t.locations)


@query(_plan_sql(FULLEST.format(role="hot"), "l.name = 'HOT_C'"))
def copy_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return transfer.copy_plan(t.inventory, t.locations, to=[" hot_c "])


@query("SELECT year, slug, rel, starts_with(rel, 'CARD_1/') AS below FROM (SELECT DISTINCT year, slug, rel FROM fx_inventory)")
def sub_folder(spark, sf_dir):
    return diff.union_listing(Tables(spark, sf_dir).inventory).select(*KEY, paths.under_prefix(F.col("rel"), "/CARD_1/").alias("below"))


_OFFERS = f"""SELECT s.year, s.slug, s.location AS src, l.name AS dst, i.rel, i.size_bytes, d.rel IS NOT NULL AS present FROM ({FULLEST.format(role="cold")}) s JOIN fx_locations l ON l.mounted AND l.name <> s.location AND l.role = 'hot' AND coalesce(l.pull, true)
JOIN fx_inventory i ON i.year = s.year AND i.slug = s.slug AND i.location = s.location LEFT JOIN fx_inventory d ON d.year = s.year AND d.slug = s.slug AND d.location = l.name AND d.rel = i.rel"""


@query(f"SELECT dst, count(*) FILTER (NOT present) AS n_files, coalesce(sum(size_bytes) FILTER (NOT present), 0)::BIGINT AS to_copy, coalesce(sum(size_bytes) FILTER (present), 0)::BIGINT AS present FROM ({_OFFERS}) GROUP BY ALL")
def transfer_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.transfer_totals(transfer.pull_offers(t.inventory, t.locations))


@query("SELECT m.year, m.slug, m.location, count(*) AS n_ghosts FROM (SELECT * FROM fx_manifest WHERE role = 'hot') m SEMI JOIN fx_inventory h ON h.year = m.year AND h.slug = m.slug AND h.location = m.location ANTI JOIN fx_inventory i ON i.year = m.year AND i.slug = m.slug AND i.location = m.location AND i.rel = m.rel GROUP BY ALL")
def sync_ghosts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return transfer.sync_ghosts(t.inventory, t.manifest)


@query("""WITH hot AS MATERIALIZED (SELECT year, slug, CAST(split_part(slug, '_', 1) AS INT) AS num, bool_or(role = 'hot') AS hot FROM fx_inventory GROUP BY ALL), y AS (SELECT DISTINCT year FROM hot)
SELECT year, num::INT AS num, CASE WHEN hot IS NULL THEN 'unknown number' WHEN NOT hot THEN 'no source' ELSE 'no such folder' END AS problem FROM (SELECT year, unnest(range(1, 15)) AS num FROM y) LEFT JOIN hot USING (year, num)""")
def unresolved_requests(spark, sf_dir):
    return transfer.unresolved(Tables(spark, sf_dir).inventory, list(range(1, 15)), "CARD_9", role="hot")


@query(f"SELECT dst, sum(size_bytes)::BIGINT AS to_copy, any_value(avail_bytes) AS avail_bytes, sum(size_bytes) > any_value(avail_bytes) AS too_large FROM ({SYNC}) JOIN fx_locations ON name = dst GROUP BY dst")
def capacity_check(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.capacity_check(reporting.transfer_totals(transfer.sync_plan(t.inventory, t.locations)), t.locations)


@query(f"SELECT (sum(size_bytes) // count(DISTINCT dst))::BIGINT AS bytes_per_destination FROM ({SYNC})")
def bytes_per_destination(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reporting.bytes_per_destination(transfer.sync_plan(t.inventory, t.locations))


# ---- fixity


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_documents(spark, sf_dir):
    return fixity.digests(Tables(spark, sf_dir).documents().select("doc_id", "text"), "text").select("doc_id", "digest")


CHECKED = "SELECT m.doc_id, m.location, m.rel, CASE WHEN c.text IS NULL THEN 'unreadable' WHEN md5(c.text) = m.digest THEN 'ok' ELSE 'mismatch' END AS status FROM fx_content_manifest m LEFT JOIN fx_content c USING (doc_id, location, rel)"


def _checked(t: Tables) -> DataFrame:
    return fixity.verify(t.content_manifest, fixity.digests(t.content, "text", "md5"), ["doc_id", "location", "rel"])


@query(CHECKED)
def verify_documents(spark, sf_dir):
    return _checked(Tables(spark, sf_dir)).select("doc_id", "location", "rel", "status")


@query(f"SELECT split_part(rel, '/', 1) AS folder, count(*) AS n_files, count(DISTINCT location) AS n_locations, count(*) FILTER (status <> 'ok') AS n_failed FROM ({CHECKED}) GROUP BY ALL")
def verify_summary(spark, sf_dir):
    return fixity.verify_summary(_checked(Tables(spark, sf_dir)).withColumn("folder", paths.top(F.col("rel"))), ["folder"])


@query("SELECT 2024 AS year, split_part(rel, '/', 1) AS slug, rel, count(DISTINCT md5(text)) AS n_digests, count(*) AS n_copies, count(text) AS n_read, min(md5(text)) AS digest, count(DISTINCT md5(text)) = 1 AND count(text) = count(*) AS agreed FROM fx_content GROUP BY ALL")
def digest_consensus(spark, sf_dir):
    computed = fixity.digests(Tables(spark, sf_dir).content, "text", "md5")
    return fixity.consensus(computed.select(F.lit(2024).alias("year"), paths.top(F.col("rel")).alias("slug"), "rel", "location", "digest"))


COMPUTED = "SELECT year, slug, rel, location, md5(rel || '|' || CAST(size_bytes AS VARCHAR)) AS digest FROM fx_inventory"


def _computed(t: Tables) -> DataFrame:
    """Digests of what the inventory holds, as the fixture defines content."""
    return t.inventory.select(*KEY, "location", F.md5(F.concat(F.col("rel"), F.lit("|"), F.col("size_bytes").cast("string"))).alias("digest"))


@query(f"SELECT year, slug, rel, location, arg_max(digest, p) AS digest FROM (SELECT year, slug, rel, location, digest, 0 AS p FROM fx_manifest UNION ALL SELECT *, 1 FROM ({COMPUTED}) WHERE location = 'COLD_A') GROUP BY ALL")
def merge_manifest(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fixity.merge_manifest(t.manifest, diff.at(_computed(t), "COLD_A"))


@query(f"""WITH open AS (SELECT year, slug, location FROM ({SCAN}) WHERE NOT checksummed), n AS (SELECT year, slug, count(*) AS n_open FROM open GROUP BY ALL),
p AS (SELECT c.year, c.slug, c.rel, count(*) AS n_copies, count(DISTINCT digest) AS n_digests, min(digest) AS digest FROM ({COMPUTED}) c SEMI JOIN open o ON o.year = c.year AND o.slug = c.slug AND o.location = c.location GROUP BY ALL),
s AS (SELECT year, slug, rel, CASE WHEN n_copies < n_open THEN 'absent' WHEN n_digests > 1 THEN 'conflict' ELSE 'new' END AS state, digest FROM p JOIN n USING (year, slug))
SELECT year, slug, rel, state, CASE WHEN state = 'new' THEN digest END AS digest, bool_and(state = 'new') OVER (PARTITION BY year, slug) AS publish FROM s""")
def build_manifests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return manifests.build_manifests(t.inventory, t.manifest, _computed(t)).drop("disputed")


@query(f"""WITH cov AS MATERIALIZED (SELECT year, slug, location, checksummed FROM ({SCAN})), p AS (SELECT c.year, c.slug, c.rel, min(c.digest) AS digest FROM ({COMPUTED}) c JOIN cov o ON o.year = c.year AND o.slug = c.slug AND o.location = c.location AND NOT o.checksummed GROUP BY ALL)
SELECT p.year, p.slug, p.rel, coalesce(bool_or(m.digest <> p.digest), false) AS disputed FROM p LEFT JOIN (SELECT x.* FROM fx_manifest x ANTI JOIN cov o ON o.year = x.year AND o.slug = x.slug AND o.location = x.location AND NOT o.checksummed) m USING (year, slug, rel) GROUP BY ALL""")
def disputed_digests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return manifests.build_manifests(t.inventory, t.manifest, _computed(t)).select(*KEY, "disputed")


@query(f"""WITH open AS MATERIALIZED (SELECT year, slug, location FROM ({SCAN}) WHERE NOT checksummed), n AS (SELECT year, slug, count(*) AS n_open FROM open GROUP BY ALL),
p AS (SELECT c.year, c.slug, c.rel, count(*) AS n_copies, count(DISTINCT digest) AS n_digests, min(digest) AS digest FROM ({COMPUTED}) c SEMI JOIN open o ON o.year = c.year AND o.slug = c.slug AND o.location = c.location GROUP BY ALL),
s AS (SELECT year, slug, rel, digest, bool_and(n_copies = n_open AND n_digests = 1) OVER (PARTITION BY year, slug) AS publish FROM p JOIN n USING (year, slug))
SELECT year, slug, rel, location, digest FROM s JOIN open USING (year, slug) WHERE publish""")
def published_manifest_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inv, man = t.inventory, t.manifest
    return manifests.new_manifest_rows(manifests.build_manifests(inv, man, _computed(t)), inv, man)


@query("SELECT sha256(text) AS digest, count(*) AS n_rows FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return fixity.duplicate_content(fixity.digests(Tables(spark, sf_dir).documents().select("doc_id", "text"), "text"))


# ---- retention

_JUDGED = """WITH hot AS (SELECT DISTINCT year, slug, rel FROM fx_inventory WHERE role = 'hot'), cold AS (SELECT DISTINCT year, slug, location, ord FROM fx_inventory SEMI JOIN hot USING (year, slug) WHERE role = 'cold'),
bad AS (SELECT c.year, c.slug, c.location, count(*) AS n FROM cold c JOIN hot h USING (year, slug) LEFT JOIN fx_inventory i ON i.year = c.year AND i.slug = c.slug AND i.location = c.location AND i.rel = h.rel
 LEFT JOIN fx_manifest m ON m.year = c.year AND m.slug = c.slug AND m.location = c.location AND m.rel = h.rel WHERE i.rel IS NULL OR m.rel IS NULL GROUP BY ALL),
con AS (SELECT b.year, b.slug, b.location, count(DISTINCT b.rel) AS n FROM fx_manifest a JOIN fx_manifest b USING (year, slug, rel) WHERE a.role = 'hot' AND b.role = 'cold' AND a.digest <> b.digest GROUP BY ALL),
listed AS (SELECT DISTINCT year, slug, location FROM fx_manifest WHERE role = 'cold'),
judged AS (SELECT c.year, c.slug, c.location, c.ord, coalesce(bad.n, 0) AS n_uncovered, coalesce(con.n, 0) AS n_conflicts, listed.year IS NOT NULL AS has_manifest, listed.year IS NOT NULL AND bad.n IS NULL AND con.n IS NULL AS qualifies
 FROM cold c LEFT JOIN bad USING (year, slug, location) LEFT JOIN con USING (year, slug, location) LEFT JOIN listed USING (year, slug, location))"""


@query(f"{_JUDGED} SELECT * FROM judged")
def evict_backups(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retain.backups(t.inventory, t.manifest).drop("n_recorded")


@query(f"""{_JUDGED}, why AS (SELECT year, slug, count(*) FILTER (qualifies) AS n_qualifying, string_agg(location || ': ' || CASE WHEN NOT has_manifest THEN 'no manifest' WHEN n_uncovered > 0 THEN 'missing ' || n_uncovered || ' files' ELSE n_conflicts || ' different digests' END, '; ' ORDER BY ord) FILTER (NOT qualifies) AS reasons FROM judged GROUP BY ALL)
SELECT h.year, h.slug, sum(size_bytes)::BIGINT AS freed_bytes, count(DISTINCT location) AS n_hot, coalesce(any_value(n_qualifying), 0) AS n_qualifying, coalesce(any_value(reasons), CASE WHEN coalesce(any_value(n_qualifying), 0) = 0 THEN 'no cold copy' ELSE '' END) AS reasons, coalesce(any_value(n_qualifying), 0) >= 2 AS releasable
FROM fx_inventory h LEFT JOIN why USING (year, slug) WHERE role = 'hot' GROUP BY ALL""")
def evict_verdict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retain.verdict(t.inventory, t.manifest, 2)


def _evict_plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    return retain.evict_plan(t.inventory, t.manifest, 1, work=work_folder(t.spark, "evict"))


@query(f"""{_JUDGED}, chosen AS (SELECT * FROM judged WHERE qualifies QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY ord) = 1),
failed AS (SELECT m.year, m.slug, count(*) FILTER (c.digest IS DISTINCT FROM m.digest) AS n_failed FROM fx_manifest m SEMI JOIN chosen s ON s.year = m.year AND s.slug = m.slug AND s.location = m.location LEFT JOIN ({COMPUTED}) c USING (year, slug, rel, location) GROUP BY ALL)
SELECT t.year, t.slug, t.location, t.bytes, coalesce(f.n_failed, 0) AS n_failed, coalesce(f.n_failed, 0) = 0 AS passed FROM ({COPIES}) t SEMI JOIN chosen s ON s.year = t.year AND s.slug = t.slug LEFT JOIN failed f ON f.year = t.year AND f.slug = t.slug WHERE role = 'hot'""")
def evict_gate(spark, sf_dir):
    t = Tables(spark, sf_dir, sized=True)
    targets, chosen = _evict_plan(t)
    man, computed = (retain.of_chosen(df, chosen) for df in (t.manifest, _computed(t)))  # other copies need not be read
    with joined_where_dealt(spark):
        gate = retain.evict_gate(targets, chosen, t.manifest, fixity.verify(man, computed), strict=False, work=work_folder(spark, "gate"))
    return gate.select(*COLLECTION, "location", "bytes", "n_failed", "passed")


_GATE = f"""{_JUDGED}, chosen AS MATERIALIZED (SELECT * FROM judged WHERE qualifies QUALIFY row_number() OVER (PARTITION BY year, slug ORDER BY ord) = 1),
failed AS (SELECT m.year, m.slug, count(*) FILTER (v.status IS DISTINCT FROM 'ok') AS n_failed FROM fx_manifest m SEMI JOIN chosen s ON s.year = m.year AND s.slug = m.slug AND s.location = m.location LEFT JOIN fx_verified v ON v.year = m.year AND v.slug = m.slug AND v.location = m.location AND v.rel = m.rel GROUP BY ALL),
gate AS (SELECT t.year, t.slug, t.location, t.bytes, f.n_failed FROM ({COPIES}) t JOIN failed f ON f.year = t.year AND f.slug = t.slug WHERE role = 'hot')"""


def _gate(spark, sf_dir, **how):
    t = Tables(spark, sf_dir, sized=True)
    targets, chosen = _evict_plan(t)
    with joined_where_dealt(spark):
        gate = retain.evict_gate(targets, chosen, t.manifest, t.verified, work=work_folder(spark, "gate"), **how)
    return gate.select(*COLLECTION, "location", "bytes", "n_failed", "passed")


@query(f"{_GATE} SELECT *, n_failed = 0 AS passed FROM gate")
def evict_gate_unverified(spark, sf_dir):
    return _gate(spark, sf_dir, strict=False)


@query(f"{_GATE} SELECT *, (SELECT sum(n_failed) FROM gate) = 0 AS passed FROM gate")
def evict_gate_strict(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(f"{_GATE} SELECT * REPLACE (0::BIGINT AS n_failed), true AS passed FROM gate")
def evict_gate_quick(spark, sf_dir):
    return _gate(spark, sf_dir, quick=True)


@query(f"""{_GATE.replace("fx_verified", "(SELECT year, slug, location, rel, 'ok' AS status FROM fx_manifest WHERE NOT (year = 1997 AND rel LIKE 'CARD_1%'))")} SELECT *, n_failed = 0 AS passed FROM gate""")
def evict_gate_foreign_rows(spark, sf_dir):
    t = Tables(spark, sf_dir, sized=True)
    targets, chosen = _evict_plan(t)
    # of one year the lines of a card were never read; as many rows of other files, and rows said twice, are no proof of them
    read = t.manifest.select(*KEY, "location", F.lit("ok").alias("status"))
    gone = (F.col("year") == 1997) & F.col("rel").startswith("CARD_1")
    foreign = read.where(gone).withColumn("rel", F.concat(F.lit("other/"), F.col("rel")))
    seen = read.where(~gone).unionByName(foreign).unionByName(read.where("year = 1996"))
    with joined_where_dealt(spark):
        gate = retain.evict_gate(targets, chosen, t.manifest, seen, strict=False, work=work_folder(spark, "gate"))
    return gate.select(*COLLECTION, "location", "bytes", "n_failed", "passed")


@query(_JUDGED.replace("WHERE role = 'hot')", "WHERE location = 'HOT_B')", 1).replace("a.role = 'hot'", "a.location = 'HOT_B'") + " SELECT year, slug, location, n_uncovered, n_conflicts, qualifies FROM judged")
def evict_backups_from(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retain.backups(t.inventory, t.manifest, hot=[" hot_b"]).select(*COLLECTION, "location", "n_uncovered", "n_conflicts", "qualifies")


# ---- ingest

_SHOT = "SELECT a.card, a.rel, a.size_bytes, coalesce(CAST(s.d AS DATE), CAST(a.mtime AS DATE)) AS day FROM fx_arrivals a LEFT JOIN (SELECT card, split_part(name, 'M01', 1) AS stem, substr(xml, 28, 10) AS d FROM fx_sidecars) s USING (card, stem)"


def _shot(t: Tables) -> DataFrame:
    return ingest.assign_shot_day(t.arrivals, t.sidecars)


@query(f"SELECT card, rel, day FROM ({_SHOT})")
def sidecar_days(spark, sf_dir):
    return _shot(Tables(spark, sf_dir)).select("card", "rel", "day")


@query(f"SELECT day, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes, list_sort(list(DISTINCT card)) AS cards FROM ({_SHOT}) GROUP BY ALL")
def arrivals_by_day(spark, sf_dir):
    return reporting.arrivals_by_day(_shot(Tables(spark, sf_dir)))


@query("SELECT i.year, i.slug, count(DISTINCT split_part(i.rel, '/', 2)) AS n_names FROM fx_inventory i SEMI JOIN fx_inventory a ON a.location = 'HOT_B' AND a.year = i.year AND split_part(a.rel, '/', 2) = split_part(i.rel, '/', 2) WHERE i.location = 'COLD_A' GROUP BY ALL")
def duplicate_arrivals(spark, sf_dir):
    inv = Tables(spark, sf_dir).inventory
    return diff.duplicate_arrivals(diff.at(inv, "HOT_B").select("year", "rel"), diff.at(inv, "COLD_A"))


@query(f"SELECT d.year, d.day, (coalesce(c.last_num, 0) + k)::INT AS num, printf('%03d_', (coalesce(c.last_num, 0) + k)::INT) || 'Day_' || day AS slug FROM (SELECT year, day, row_number() OVER (PARTITION BY year ORDER BY day) AS k FROM (SELECT DISTINCT CAST(year(day) AS INT) AS year, day FROM ({_SHOT}))) d LEFT JOIN fx_counters c USING (year)")
def ingest_numbers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    days = _shot(t).select(F.year("day").alias("year"), "day").distinct().withColumn("name", F.concat(F.lit(" Day "), F.col("day").cast("string")))
    return numbering.assign_numbers(days, t.counters)


@query(f"""WITH shot AS MATERIALIZED ({_SHOT}), numbered AS (SELECT day, printf('%03d_Shoot', (coalesce(c.last_num, 0) + k)::INT) AS slug, year FROM (SELECT CAST(year(day) AS INT) AS year, day, row_number() OVER (PARTITION BY year(day) ORDER BY day) AS k FROM (SELECT DISTINCT day FROM shot)) LEFT JOIN fx_counters c USING (year)),
wanted AS (SELECT n.year, n.slug, card, card || '/' || rel AS rel, l.name AS dst, size_bytes FROM shot JOIN numbered n USING (day) JOIN fx_locations l ON l.mounted AND l.role = 'hot')
SELECT w.* FROM wanted w ANTI JOIN fx_inventory i ON i.year = w.year AND i.slug = w.slug AND i.rel = w.rel AND i.location = w.dst""")
def ingest_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    given = _shot(t).select("day").distinct().select("day", F.lit("Shoot").alias("name"), F.lit(None).cast("string").alias("slug"))
    plan, _ = ingest.ingest_plan(t.arrivals, t.sidecars, t.inventory, t.counters, given, t.locations)
    return plan.select("year", "slug", "card", "rel", "dst", "size_bytes")


# ---- organising and numbering


def _name_date_sql() -> str:
    parts = lambda p: [f"TRY_CAST(regexp_extract(base, '{p}', {k}) AS INT)" for k in (1, 2, 3)]
    good = lambda y, m, d: f"{y} BETWEEN 1990 AND 2100 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
    day = lambda y, m, d: f"CASE WHEN {good(y, m, d)} THEN CAST(make_date({y}, {m}, 1) + ({d} - 1) AS DATE) END"
    return f"coalesce({day(*parts(dates.DASHED))}, {day(*parts(dates.PACKED))})"


_LOOSE = f"SELECT location, year, rel, size_bytes, base, named, coalesce(named, CAST(mtime AS DATE)) AS shot_at FROM (SELECT *, {_name_date_sql()} AS named FROM (SELECT *, split_part(rel, '/', 2) AS base FROM fx_loose))"
_SEASON = "CASE WHEN month(shot_at) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(shot_at) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(shot_at) BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END"
_TURN = "CASE season WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 WHEN 'Autumn' THEN 3 ELSE 4 END"
_SLUGS = f"""SELECT s.year, s.season, printf('%03d_', (greatest(coalesce(c.last_num, 0), coalesce(m.n, 0)) + k)::INT) || season AS slug FROM (SELECT year, season, row_number() OVER (PARTITION BY year ORDER BY {_TURN}) AS k FROM (SELECT DISTINCT year, {_SEASON} AS season FROM ({_LOOSE}))) s
LEFT JOIN fx_counters c USING (year) LEFT JOIN (SELECT year, max(CAST(split_part(slug, '_', 1) AS INT)) AS n FROM fx_inventory GROUP BY ALL) m USING (year)"""


@query(f"SELECT location, year, rel, named AS name_date, shot_at, CASE WHEN named IS NULL THEN 'mtime' ELSE 'filename' END AS date_source FROM ({_LOOSE})")
def filename_dates(spark, sf_dir):
    files = Tables(spark, sf_dir).loose
    return organise.dated(files).select("location", "year", "rel", dates.filename_date(F.col("rel")).alias("name_date"), "shot_at", "date_source")


@query(f"SELECT location, year, {_SEASON} AS season, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM ({_LOOSE}) GROUP BY ALL")
def season_groups(spark, sf_dir):
    found = organise.dated(organise.organise_candidates(Tables(spark, sf_dir).loose))
    return organise.season_totals(found.withColumnRenamed("season", "new_slug")).withColumnRenamed("new_slug", "season")


@query(_SLUGS)
def season_slugs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return numbering.season_slugs(organise.dated(t.loose), t.counters, t.inventory)


@query(f"""WITH f AS (SELECT l.location, l.year, l.rel, l.base, s.slug AS new_slug FROM (SELECT *, {_SEASON} AS season FROM ({_LOOSE})) l JOIN ({_SLUGS}) s USING (year, season)),
n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY location, year, new_slug, base) > 1 THEN replace(rel, '/', '_') ELSE base END AS name FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY location, year, new_slug, name ORDER BY rel) AS k FROM n)
SELECT location, year, rel, new_slug, CASE WHEN k > 1 THEN regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) ELSE name END AS new_name FROM k""")
def flat_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return organise.organise_plan(t.loose, t.counters, t.inventory).select("location", "year", "rel", "new_slug", "new_name")


def _unique_sql(cte: str) -> str:
    """Column name of cte made unique in (location, year, new_slug): counted on from the highest number after its stem."""
    stem, ext = "regexp_replace(name, '\\.[^.]*$', '')", "regexp_extract(name, '(\\.[^.]*)$', 1)"
    return f"""SELECT location, year, rel, new_slug, CASE WHEN k = 1 THEN name ELSE stem || '_' || (greatest(coalesce(most, 1), 1) + k - 1) || ext END AS new_name
FROM (SELECT *, {stem} AS stem, {ext} AS ext, row_number() OVER (PARTITION BY location, year, new_slug, name ORDER BY rel) AS k FROM {cte})
LEFT JOIN (SELECT location, year, new_slug, regexp_replace({stem}, '_[0-9]+$', '') AS stem, {ext} AS ext, max(TRY_CAST(regexp_extract({stem}, '_([0-9]+)$', 1) AS BIGINT)) AS most FROM {cte} WHERE regexp_matches({stem}, '_[0-9]+$') GROUP BY ALL) USING (location, year, new_slug, stem, ext)"""


@query(f"""WITH f AS (SELECT location, year, rel, split_part(rel, '/', -1) AS base, {_name_date_sql().replace('base', "split_part(rel, '/', -1)")} AS shot_at FROM fx_chained),
s AS MATERIALIZED (SELECT *, {_SEASON} AS season FROM f WHERE shot_at IS NOT NULL), n AS (SELECT year, season, printf('%03d_', (greatest(coalesce(c.last_num, 0), coalesce(m.n, 0)) + k)::INT) || season AS new_slug FROM (SELECT year, season, row_number() OVER (PARTITION BY year ORDER BY {_TURN}) AS k FROM (SELECT DISTINCT year, season FROM s))
 LEFT JOIN fx_counters c USING (year) LEFT JOIN (SELECT year, max(CAST(split_part(slug, '_', 1) AS INT)) AS n FROM fx_inventory GROUP BY ALL) m USING (year)),
named AS MATERIALIZED (SELECT location, year, rel, new_slug, CASE WHEN count(*) OVER (PARTITION BY location, year, new_slug, base) > 1 THEN replace(rel, '/', '_') ELSE base END AS name FROM s JOIN n USING (year, season)
 UNION ALL SELECT location, year, rel, '_unsorted', replace(rel, '/', '_') FROM f WHERE shot_at IS NULL) {_unique_sql('named')}""")
def flat_names_chained(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return organise.organise_plan(t.chained, t.counters, t.inventory, allow_mtime=False).select("location", "year", "rel", "new_slug", "new_name")


_NUMBERED = "SELECT DISTINCT year, slug, CAST(split_part(slug, '_', 1) AS INT) AS num FROM fx_spaced"
_RENUMBER = f"SELECT year, slug, new_slug FROM (SELECT year, slug, printf('%03d_', row_number() OVER (PARTITION BY year ORDER BY num, slug)::INT) || split_part(slug, '_', 2) AS new_slug FROM ({_NUMBERED})) WHERE slug <> new_slug"


@query(_RENUMBER)
def renumber_plan(spark, sf_dir):
    return organise.renumber_plan(Tables(spark, sf_dir).spaced)[0]


@query(f"SELECT i.year, coalesce(m.new_slug, i.slug) AS slug, i.location, i.rel, i.size_bytes FROM fx_spaced i LEFT JOIN ({_RENUMBER}) m USING (year, slug)")
def apply_path_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inv, _ = organise.apply_path_map(t.spaced, t.spaced_manifest, organise.renumber_plan(t.spaced)[0])
    return inv.select(*COLLECTION, "location", "rel", "size_bytes")


@query(f"WITH map AS ({_RENUMBER}), touched AS (SELECT year, slug FROM map UNION SELECT year, new_slug FROM map) SELECT year, slug, location, rel, digest FROM fx_spaced_manifest SEMI JOIN touched USING (year, slug)")
def stale_manifests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    stale = organise.stale_manifests(t.spaced_manifest, organise.renumber_plan(t.spaced)[0])
    return stale.select(*COLLECTION, "location", "rel", "digest")


@query("SELECT year, coalesce(last_num, 0) AS last_num, greatest(max_num, coalesce(last_num, 0)) AS new_num FROM (SELECT year, max(CAST(split_part(slug, '_', 1) AS INT)) AS max_num FROM fx_inventory GROUP BY ALL) LEFT JOIN fx_counters USING (year)")
def recover_counters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return organise.recover_counters(t.inventory, t.counters)


@query("SELECT location, rel, size_bytes FROM fx_raw_listing WHERE NOT regexp_matches(rel, '(^|/)(\\.|@eaDir/|@tmp/)|@SynoResource($|/)|(^|/)(Thumbs\\.db|desktop\\.ini)$')")
def junk_filter(spark, sf_dir):
    return Tables(spark, sf_dir).raw_listing.where(paths.visible(F.col("rel")))


_FOLDERS = "SELECT DISTINCT location, array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT location, string_split(rel, '/') AS p, unnest(range(1, len(string_split(rel, '/')))) AS k FROM fx_raw_listing)"


def _folders(listing: DataFrame) -> DataFrame:
    return listing.where("instr(rel, '/') > 0").select("location", F.explode(paths.ancestors(F.col("rel"))).alias("dir")).distinct()


@query(f"""SELECT count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files, coalesce(sum(size_bytes) FILTER (NOT is_dir), 0)::BIGINT AS bytes FROM (
SELECT false AS is_dir, size_bytes, split_part(rel, '/', -1) AS name FROM fx_raw_listing UNION ALL SELECT true, 0, split_part(dir, '/', -1) FROM ({_FOLDERS}))
WHERE name LIKE '%@SynoResource' OR (is_dir AND name IN ('@eaDir', '@tmp')) OR (NOT is_dir AND (name IN ('Thumbs.db', 'desktop.ini') OR starts_with(name, '._')))""")
def junk_summary(spark, sf_dir):
    listing = Tables(spark, sf_dir).raw_listing
    files = listing.select("rel", F.lit(False).alias("is_dir"), "size_bytes")
    folders = _folders(listing).select(F.col("dir").alias("rel"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size_bytes"))
    return reporting.junk_summary(files.unionByName(folders))


_JUNK_ROW = "regexp_matches(rel, '(^|/)(@eaDir|@tmp)/|@SynoResource($|/)|(^|/)(Thumbs\\.db|desktop\\.ini)$|(^|/)\\._[^/]*$')"


@query(f"SELECT location, rel, md5(rel) AS digest FROM fx_raw_listing WHERE {_JUNK_ROW}")
def prune_manifest(spark, sf_dir):
    man = Tables(spark, sf_dir).raw_listing.select("location", "rel", F.md5("rel").alias("digest"))
    return organise.prune_manifest(man)


@query(f"""WITH kept AS (SELECT location, rel FROM fx_raw_listing WHERE NOT {_JUNK_ROW}), used AS (SELECT DISTINCT location, array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT location, string_split(rel, '/') AS p, unnest(range(1, len(string_split(rel, '/')))) AS k FROM kept))
SELECT location, dir FROM ({_FOLDERS}) ANTI JOIN used USING (location, dir) WHERE len(string_split(dir, '/')) > 2""")
def empty_folders(spark, sf_dir):
    listing = Tables(spark, sf_dir).raw_listing
    return organise.empty_folders(listing, _folders(listing))


@query("""WITH n AS (SELECT DISTINCT year, CAST(split_part(slug, '_', 1) AS INT) AS num FROM fx_inventory), b AS (SELECT year, min(num) AS low, max(num) AS high FROM n GROUP BY ALL)
SELECT DISTINCT year, num FROM (SELECT year, unnest(generate_series(low, least(low + 3, high)))::INT AS num FROM b UNION ALL SELECT year, high FROM b)""")
def expand_selection(spark, sf_dir):
    nums = Tables(spark, sf_dir).inventory.groupBy("year").agg(F.min(paths.number(F.col("slug"))).alias("low"), F.max(paths.number(F.col("slug"))).alias("high"))
    text = F.concat_ws("", F.col("low"), F.lit("-"), F.least(F.col("low") + 3, F.col("high")), F.lit(", "), F.col("high"))
    return nums.select("year", F.explode(paths.expand_selection(text)).alias("num"))


@query("""WITH n AS (SELECT DISTINCT year, slug, ord, CAST(split_part(slug, '_', 1) AS INT) AS num FROM fx_inventory)
SELECT num, year, slug FROM n QUALIFY row_number() OVER (PARTITION BY num ORDER BY year DESC, ord, slug) = 1""")
def resolve_number(spark, sf_dir):
    coll = Tables(spark, sf_dir).inventory.select("year", "slug", "ord").distinct()
    wanted = coll.select(paths.number(F.col("slug")).alias("num"))
    return selection.resolve_number(coll, wanted, across_years=True)


# ---- written and read back


@query("SELECT year, slug, location, rel, digest FROM fx_manifest WHERE role = 'hot'")
def manifest_roundtrip(spark, sf_dir):
    out = f"{work_folder(spark, 'manifests')}/written"
    io.write_manifests(Tables(spark, sf_dir).manifest.where("role = 'hot'"), out)
    return io.read_written_manifests(spark, out)


def _content(t: Tables) -> DataFrame:
    return t.content.select("location", F.lit(2024).alias("year"), paths.top(F.col("rel")).alias("slug"), "rel", F.col("text").cast("binary").alias("content"))


@query("""WITH planned AS (SELECT rel, text FROM fx_content a WHERE location = 'COLD_A' AND NOT EXISTS (SELECT 1 FROM fx_content b WHERE b.location = 'COLD_B' AND b.rel = a.rel))
SELECT 2024 AS year, split_part(rel, '/', 1) AS slug, rel, 'COLD_B' AS location, sha256(text) AS digest FROM planned
UNION ALL SELECT 2024, split_part(rel, '/', 1), rel, location, digest FROM fx_content_manifest WHERE NOT (location = 'COLD_B' AND rel IN (SELECT rel FROM planned))""")
def execute_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    content = _content(t)
    lacking = diff.missing(diff.at(content, "COLD_A"), diff.at(content, "COLD_B"))
    plan = lacking.select(*KEY, F.lit("COLD_A").alias("src"), F.lit("COLD_B").alias("dst"), F.octet_length("content").alias("size_bytes"))
    man = t.content_manifest.select(F.lit(2024).alias("year"), paths.top(F.col("rel")).alias("slug"), "rel", "location", "digest")
    return transfer.execute_plan(plan, content, man, work_folder(spark, "copies"))


@query("SELECT year, slug, rel, location, size_bytes FROM fx_inventory WHERE role = 'hot'")
def ingest_incremental(spark, sf_dir):
    root = work_folder(spark, "stream")
    rows = Tables(spark, sf_dir).inventory.where("role = 'hot'").select(*KEY, "location", "size_bytes")
    # the second delivery repeats part of the first
    rows.where("location <> 'HOT_C'").write.mode("append").parquet(f"{root}/listing")
    schema = "year int, slug string, rel string, location string, size_bytes long"
    stream.ingest_incremental(spark, f"{root}/listing", schema, f"{root}/target", f"{root}/state").awaitTermination()
    rows.where("location <> 'HOT_A'").write.mode("append").parquet(f"{root}/listing")
    stream.ingest_incremental(spark, f"{root}/listing", schema, f"{root}/target", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/target")
