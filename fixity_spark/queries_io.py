"""More registered queries: readers and writers on files that the query writes from the tables, value functions and
whole composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions import dates, paths, values
from fixity_spark.operators import diff, fixity, locations, numbering, reporting
from fixity_spark.plans import catalogue, manifests, organise, transfer
from fixity_spark.queries import _CELL, _FOLDERS, _JUNK_ROW, _SHOT, COMPUTED, SCAN, SIZES, Tables, _computed, _content, _folders, _shot, _size_sql, query
from fixity_spark.schema import COLLECTION, KEY, MANIFEST
from fixity_spark.scratch import work_folder
from fixity_spark.sources import io

# ---- files


def _tree(t: Tables, by: str) -> str:
    """Manifest lines of COLD_B as a tree <root>/<year>/<slug>/..., a file for each value of by in a folder; a job for each
    of the few years. One location has hundreds of files already."""
    root = work_folder(t.spark, "tree")
    rows = diff.at(t.manifest, "COLD_B").select("year", F.col("slug").alias("s"), F.expr(by).alias("c"), F.format_string("%s  %s", "digest", "rel").alias("value")).cache()
    for r in rows.select("year").distinct().collect():
        rows.where(F.col("year") == r.year).drop("year").repartition("s", "c").write.partitionBy("s", "c").text(f"{root}/{r.year}")
    rows.unpersist()
    return root


@query("SELECT year, slug, 'X' AS location, split_part(rel, '/', 1) AS card, sum(length(digest) + length(rel) + 3)::BIGINT AS size_bytes FROM fx_manifest WHERE location = 'COLD_B' GROUP BY ALL")
def scanned_tree(spark, sf_dir):
    """A row for each file, with its folder and size: the files of a folder are those of its cards."""
    rows = io.read_inventory(spark, _tree(Tables(spark, sf_dir), "substring_index(rel, '/', 1)"), "X")
    return rows.select("year", F.replace("slug", F.lit("s=")).alias("slug"), "location", F.replace(paths.top(F.col("rel")), F.lit("c=")).alias("card"), "size_bytes")


@query("SELECT year, slug, 'X' AS location, rel, digest FROM fx_manifest WHERE location = 'COLD_B'")
def parsed_manifests(spark, sf_dir):
    rows = io.read_manifests(spark, f"{_tree(Tables(spark, sf_dir), '0')}/*/*/*/*", "X")
    return rows.select("year", F.replace("slug", F.lit("s=")).alias("slug"), "location", "rel", "digest")


@query("SELECT i.year, i.slug, i.location, count(*) AS files, coalesce(any_value(g.n), 0) AS n_ghosts FROM fx_inventory i LEFT JOIN (SELECT year, slug, location, count(*) AS n FROM fx_manifest m ANTI JOIN fx_inventory x USING (year, slug, location, rel) GROUP BY ALL) g ON g.year = i.year AND g.slug = i.slug AND g.location = i.location GROUP BY ALL")
def listed_collections(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inv, man = t.inventory, t.manifest
    # a manifest lies beside the files it lists, and lists itself
    self_rows = lambda df, extra: df.select(*COLLECTION, "location").distinct().withColumns({"rel": F.lit(MANIFEST), **extra})
    inv = inv.select(*KEY, "location", "size_bytes").unionByName(self_rows(inv, {"size_bytes": F.lit(9).cast("long")}))
    man = man.select(*KEY, "location", "digest").unionByName(self_rows(man, {"digest": F.lit("d")}))
    files, ghosts = io.collection_files(inv, man)
    counted = files.groupBy(*COLLECTION, "location").agg(F.count("*").alias("files"))
    return counted.join(ghosts, [*COLLECTION, "location"], "left").na.fill(0, ["n_ghosts"])


@query("SELECT 2024 AS year, split_part(rel, '/', 2) AS slug, location, substr(rel, 7 + length(split_part(rel, '/', 2))) AS rel, size_bytes FROM fx_raw_listing WHERE NOT regexp_matches(rel, '(^|/)(\\.|@eaDir/|@tmp/)|@SynoResource($|/)|(^|/)(Thumbs\\.db|desktop\\.ini)$')")
def listing_as_inventory(spark, sf_dir):
    place = {"year": "CAST(substring_index(rel, '/', 1) AS INT)", "slug": "split_part(rel, '/', 2)", "location": "location", "rel": "array_join(slice(split(rel, '/'), 3, 99), '/')", "size_bytes": "size_bytes"}
    return io.inventory_from_table(Tables(spark, sf_dir).raw_listing, place)


@query("""SELECT s_nationkey::INT AS ord, 'D' || s_nationkey AS name, '/Volumes/D' || s_nationkey AS base, 'hot' AS role, 1990 + s_nationkey::INT AS year_from, 0 AS year_to, s_nationkey % 2 = 0 AS mounted, CASE WHEN s_nationkey % 2 = 0 THEN count(*) ELSE 0 END AS avail_bytes, CASE WHEN s_nationkey % 2 = 0 THEN count(*) * 2 ELSE 0 END AS total_bytes
FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT k FROM supplier, range(25) r(k)) GROUP BY s_nationkey""")
def configured_locations(spark, sf_dir):
    out = f"{work_folder(spark, 'config')}/config"
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey")
    # every nation is a drive, whether or not a supplier is there
    nation = sup.unionByName(sup.select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("s_nationkey"))).groupBy("s_nationkey").agg(F.count("*").alias("n"))
    drive = F.struct(F.col("s_nationkey").cast("int").alias("_k"), F.format_string("D%d", "s_nationkey").alias("volume"), F.lit("Root").alias("root"), F.lit("hot").alias("role"), (F.col("s_nationkey") + 1990).cast("int").alias("year_from"))
    nation.agg(F.to_json(F.struct(F.array_sort(F.collect_list(drive)).alias("drives"))).alias("value")).coalesce(1).write.text(out)
    room = nation.where("s_nationkey % 2 = 0").select(F.format_string("D%d", "s_nationkey").alias("name"), F.col("n").alias("avail_bytes"), (F.col("n") * 2).alias("total_bytes"))
    return locations.with_room(io.read_locations(spark, out), room).select("ord", "name", "base", "role", "year_from", "year_to", "mounted", "avail_bytes", "total_bytes")


MAX_NUMBER = "SELECT year, max(CAST(split_part(slug, '_', 1) AS INT)) AS last_num FROM fx_inventory GROUP BY ALL"


def _observed(t: Tables) -> DataFrame:
    return reporting.max_number(t.inventory).withColumnRenamed("max_num", "last_num")


@query(MAX_NUMBER)
def counters_from_json(spark, sf_dir):
    out = f"{work_folder(spark, 'counters')}/seq"
    kept = F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), "last_num")))
    _observed(Tables(spark, sf_dir)).agg(F.to_json(kept).alias("value")).write.text(out)
    return io.read_counters(spark, out)


@query(MAX_NUMBER)
def written_counters(spark, sf_dir):
    out = f"{work_folder(spark, 'counters')}/table"
    io.write_counters(_observed(Tables(spark, sf_dir)), out)
    return spark.read.parquet(out)


@query(f"SELECT year, last_num + 1 AS next_num, last_num + 1 AS committed, greatest(last_num - 1, 0) AS reverted FROM ({MAX_NUMBER})")
def stepped_counters(spark, sf_dir):
    held = _observed(Tables(spark, sf_dir))
    years = [r.year for r in held.select("year").collect()]
    step = lambda by, name: numbering.step(held, years, by).withColumnRenamed("last_num", name)
    return numbering.peek(held).join(step(1, "committed"), "year").join(step(-1, "reverted"), "year")


@query("SELECT card, CAST(substr(xml, 28, 10) AS DATE) AS shot, sum(length(xml) + 1)::BIGINT AS n_chars FROM fx_sidecars GROUP BY ALL")
def read_back_sidecars(spark, sf_dir):
    root = f"{work_folder(spark, 'sidecars')}/cards"
    cars = Tables(spark, sf_dir).sidecars.select("card", dates.sidecar_date(F.col("xml")).alias("shot"), F.col("xml").alias("value"))
    cars.repartition("card", "shot").write.partitionBy("card", "shot").text(root)
    # a file holds the sidecars of a card and day, as one text
    cards = [r.card for r in cars.select("card").distinct().collect()]  # as many as there are card readers
    read = [io.read_sidecars(spark, f"{root}/card={c}/*/*", c) for c in cards]
    rows = read[0]
    for more in read[1:]:
        rows = rows.unionByName(more)
    return rows.select("card", dates.sidecar_date(F.col("xml")).alias("shot"), F.length("xml").cast("long").alias("n_chars"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(CAST(mtime AS DATE) AS TIMESTAMP) + INTERVAL 37230 SECOND END AS probed, CAST(mtime AS DATE) AS day, CASE WHEN event_id % 4 < 2 THEN 'probe' ELSE 'mtime' END AS source FROM fx_probes")
def probe_dates(spark, sf_dir):
    rows = io.parse_probe(Tables(spark, sf_dir).probes, "output").withColumn("at", dates.probe_date(F.col("output")))
    day, source = dates.shot_date(F.col("at"), F.col("rel"), F.col("mtime"))
    return rows.select("event_id", F.col("at").cast("timestamp_ntz").alias("probed"), day.alias("day"), source.alias("source"))


@query("SELECT m.year, m.slug, m.location, m.rel FROM fx_manifest m ANTI JOIN fx_inventory i USING (year, slug, location, rel)")
def written_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = f"{work_folder(spark, 'findings')}/ghosts"
    io.write_findings(diff.ghosts(t.inventory, t.manifest).select(*COLLECTION, "location", "rel"), out)
    return spark.read.parquet(out)


# ---- values


@query("SELECT year, slug, location, rel, digest FROM fx_manifest")
def without_self_entries(spark, sf_dir):
    man = Tables(spark, sf_dir).manifest.select(*COLLECTION, "location", "rel", "digest")
    own = man.select(*COLLECTION, "location").distinct().withColumns({"rel": F.lit(MANIFEST), "digest": F.lit("d")})
    return diff.drop_self_entry(man.unionByName(own))


@query("SELECT i.year, i.slug, n.num, CAST(split_part(i.slug, '_', 1) AS INT) = n.num AS addressed FROM (SELECT DISTINCT year, slug FROM fx_inventory) i JOIN (SELECT DISTINCT year, CAST(split_part(slug, '_', 1) AS INT) AS num FROM fx_inventory) n USING (year)")
def addressable_numbers(spark, sf_dir):
    coll = reporting.collections(Tables(spark, sf_dir).inventory)
    nums = coll.select("year", paths.number(F.col("slug")).alias("num")).distinct()
    return coll.join(nums, "year").select(*COLLECTION, "num", paths.has_number(F.col("slug"), F.col("num")).alias("addressed"))


@query("SELECT DISTINCT o_orderkey, o_orderkey BETWEEN 2000 AND 2099 AS is_year, year(o_orderdate)::INT AS local_year, year(o_orderdate) // 10 = 199 AS nineties FROM orders")
def year_names(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate").distinct()
    year = dates.local_year(F.col("o_orderdate"))
    return orders.select("o_orderkey", paths.is_year(F.col("o_orderkey").cast("string")).alias("is_year"), year.alias("local_year"), F.expr("year(o_orderdate) div 10 = 199").alias("nineties"))


@query("SELECT year, slug, location, rel, substr(digest, 1, 8) AS short FROM fx_manifest")
def short_digests(spark, sf_dir):
    return Tables(spark, sf_dir).manifest.select(*COLLECTION, "location", "rel", values.short_hash(F.col("digest")).alias("short"))


@query("SELECT location, rel, len(string_split(rel, '/')) - 1 AS depth, split_part(rel, '/', -1) AS base, CASE WHEN location = '' THEN '' ELSE location END AS name FROM fx_raw_listing")
def path_parts(spark, sf_dir):
    rel: Column = F.col("rel")
    return Tables(spark, sf_dir).raw_listing.select("location", "rel", paths.depth(rel).alias("depth"), paths.base_name(rel).alias("base"), values.location_name(F.lit(""), F.concat(F.lit("/x/"), F.col("location"), F.lit("/"))).alias("name"))


# ---- composites


@query(f"SELECT year, slug, bytes, {_size_sql('bytes')} AS size, {_CELL} FROM ({SIZES}) JOIN ({SCAN.replace('sum(size_bytes)::BIGINT AS bytes, ', '')}) USING (year, slug) GROUP BY year, slug, bytes")
def catalogue_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalogue.catalogue(t.inventory, t.manifest, t.locations)[0]


@query(f"SELECT year, slug, {_CELL} FROM ({SCAN}) GROUP BY ALL")
def status_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalogue.status(t.inventory, t.manifest, t.locations)[1]


@query("SELECT ord, name, role, total_bytes - avail_bytes AS used_bytes, total_bytes, least(1.0, (total_bytes - avail_bytes) / total_bytes::DOUBLE)::DOUBLE AS used_ratio, (SELECT count(*) FROM fx_inventory i WHERE i.location = name) AS files FROM fx_locations WHERE mounted")
def status_room(spark, sf_dir):
    t = Tables(spark, sf_dir)
    held = t.inventory.groupBy(F.col("location").alias("name")).agg(F.count("*").alias("files"))
    return catalogue.status(t.inventory, t.manifest, t.locations)[0].join(held, "name", "left").na.fill(0, ["files"])


@query("""WITH c AS MATERIALIZED (SELECT m.rel, m.location, CASE WHEN f.text IS NOT NULL AND sha256(f.text) = m.digest THEN 'ok' ELSE 'bad' END AS status FROM (SELECT doc_id, location, rel, CASE WHEN doc_id % 31 = 0 THEN 'rot' ELSE sha256(text) END AS digest FROM fx_content) m LEFT JOIN fx_content f USING (doc_id, location, rel))
SELECT 2024 AS year, split_part(rel, '/', 1) AS slug, count(*) AS n_files, count(DISTINCT location) AS n_locations, count(*) FILTER (status <> 'ok') AS n_failed, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'failed' ELSE 'ok' END AS state FROM c GROUP BY ALL""")
def verified_collections(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.content.select(F.lit(2024).alias("year"), paths.top(F.col("rel")).alias("slug"), "rel", "location", F.when(F.col("doc_id") % 31 == 0, "rot").otherwise(F.sha2("text", 256)).alias("digest"))
    return manifests.verify(rows, _content(t))[1].drop("n_other_algo")


@query(f"""WITH kept AS (SELECT location, rel FROM fx_raw_listing WHERE NOT {_JUNK_ROW}), used AS (SELECT DISTINCT location, array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT location, string_split(rel, '/') AS p, unnest(range(1, len(string_split(rel, '/')))) AS k FROM kept))
SELECT 'junk' AS what, location, rel AS path FROM fx_raw_listing WHERE {_JUNK_ROW} UNION ALL SELECT 'line', location, rel FROM fx_raw_listing WHERE {_JUNK_ROW}
UNION ALL SELECT 'folder', location, dir FROM ({_FOLDERS}) ANTI JOIN used USING (location, dir) WHERE len(string_split(dir, '/')) > 2""")
def clean_plan(spark, sf_dir):
    listing = Tables(spark, sf_dir).raw_listing
    junk, lines, folders = organise.clean_plan(listing, listing.select("location", "rel", F.md5("rel").alias("digest")), _folders(listing))
    named = lambda df, what, path: df.select(F.lit(what).alias("what"), "location", F.col(path).alias("path"))
    return named(junk, "junk", "rel").unionByName(named(lines, "line", "rel")).unionByName(named(folders, "folder", "dir"))


@query(f"WITH s AS MATERIALIZED ({_SHOT}) SELECT day, count(*) AS n_files, count(DISTINCT card) AS n_cards FROM s GROUP BY ALL")
def arrival_days(spark, sf_dir):
    return reporting.arrivals_by_day(_shot(Tables(spark, sf_dir))).select("day", "n_files", F.size("cards").cast("long").alias("n_cards"))


@query(f"SELECT year, slug, location, rel, digest FROM ({COMPUTED})")
def merged_twice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    once = fixity.merge_manifest(_computed(t).withColumn("digest", F.lit("old")), _computed(t))
    return fixity.merge_manifest(once, _computed(t))


def _copy_runs(t: Tables) -> tuple[DataFrame, str]:
    """The manifest after the same plan ran three times over contents that change, and where the copies are."""
    target = work_folder(t.spark, "runs")
    content = _content(t)
    lacking = diff.missing(diff.at(content, "COLD_A"), diff.at(content, "COLD_B"))
    plan = lacking.select(*KEY, F.lit("COLD_A").alias("src"), F.lit("COLD_B").alias("dst"), F.octet_length("content").alias("size_bytes"))
    man = t.content_manifest.select(F.lit(2024).alias("year"), paths.top(F.col("rel")).alias("slug"), "rel", "location", "digest")
    for state in ("one", "two", "three"):
        man = transfer.execute_plan(plan, content.withColumn("content", F.concat("content", F.lit(state).cast("binary"))), man, target)
    return man, target


_PLANNED = "SELECT rel, text FROM fx_content a WHERE location = 'COLD_A' AND rel NOT IN (SELECT rel FROM fx_content WHERE location = 'COLD_B')"


@query(f"""WITH planned AS MATERIALIZED ({_PLANNED}) SELECT 2024 AS year, split_part(rel, '/', 1) AS slug, rel, 'COLD_B' AS location, sha256(text || 'three') AS digest FROM planned
UNION ALL SELECT 2024, split_part(rel, '/', 1), rel, location, digest FROM fx_content_manifest WHERE NOT (location = 'COLD_B' AND rel IN (SELECT rel FROM planned))""")
def execute_plan_again(spark, sf_dir):
    return _copy_runs(Tables(spark, sf_dir))[0]


@query(f"SELECT rel, 'COLD_B' AS location, sha256(text || 'three') AS digest, md5(text || 'three') AS md5 FROM ({_PLANNED})")
def newest_copies(spark, sf_dir):
    rows = transfer.copied(spark, _copy_runs(Tables(spark, sf_dir))[1])
    return rows.select("rel", "location", "digest", F.md5("content").alias("md5"))
