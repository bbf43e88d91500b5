import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_operators import inv, locs, man, rows

from fixity_spark.operators import diff, fixity, locations, reconcile, selection
from fixity_spark.operators.fingerprint import fingerprints
from fixity_spark.plans import check, organise, transfer


def test_fingerprints_tell_sets_apart(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "y", None), ("b", "x", 1), ("c", "x", None), ("c", "y", 1), ("d", "x", 1), ("d", "x", 1), ("d", "y", None)], "g string, r string, n int")
    got = {r.g: r["print"] for r in fingerprints(df.repartition(3), ["g"], ["r", "n"]).collect()}
    assert got["a"] == got["b"] and len({got[g] for g in "acd"}) == 3
    assert got["a"].n == 2 and got["d"].n == 3


def test_only_differing_collections_are_shuffled(spark, tmp_path):
    same = [(f"{k:03d}_s", loc, f"f{j}", j) for k in range(40) for loc in ("H1", "C1") for j in range(25)]
    i = inv(spark, *same, ("900_x", "H1", "a", 1), ("900_x", "H1", "b", 1), ("900_x", "C1", "a", 2), ("901_y", "H1", "a", 1), ("901_y", "C1", "a", 1))
    m = man(spark, *((s, loc, f, "d") for s, loc, f, _ in same), ("901_y", "H1", "a", "1"), ("901_y", "C1", "a", "2"), ("005_s", "C1", "gone", "d"))
    one = locs(spark).where("name <> 'C2'")
    assert rows(check.open_collections(i, m, one), "slug") == [("005_s",), ("900_x",), ("901_y",)]
    quick, plain = (sorted(map(str, check.check(i, m, one, work=w)[0].collect())) for w in (str(tmp_path / "w"), None))
    assert quick == plain and len(plain) == 4

    def shuffled(df):
        df.collect()
        plan, seen = df._jdf.queryExecution().executedPlan(), 0
        work = [plan]
        while work:
            p = work.pop()
            name = p.nodeName()
            if name == "AdaptiveSparkPlan":
                work.append(p.executedPlan())
                continue
            if name.endswith("QueryStage"):
                work.append(p.plan())
                continue
            if name == "Exchange" and p.metrics().contains("shuffleBytesWritten"):
                seen += p.metrics().apply("shuffleBytesWritten").value()
            children = p.children()
            work += [children.apply(k) for k in range(children.size())]
        return seen

    facts = check._facts(i, one)
    among = locations.small(spark.createDataFrame([(2024, "900_x")], "year int, slug string"))
    few, whole = ([df.join(among, ["year", "slug"], "left_semi") for df in (i, m)], [i, m])
    assert shuffled(check._of_files(*few, facts)) < 0.5 * shuffled(check._of_files(*whole, facts))


def test_agreed_copies_by_fingerprint(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "H2", "x", 1), ("a", "H2", "checksums.b3", 9), ("b", "H1", "x", 1), ("b", "H2", "x", 2), ("c", "H3", "x", 0))
    assert rows(selection.disagreeing(i), "slug") == [("b",)]
    assert rows(selection.pick_agreed(i), "slug", "location") == [("a", "H1"), ("c", "H3")]


PATHS = "year int, slug string, rel string, size_bytes long"


def listing(spark, names, extra=()):
    return spark.createDataFrame([(2024, f"s{n % 7}", f"f{n}", n) for n in names] + list(extra), PATHS)


@pytest.mark.parametrize("shares", [None, 1, 4])
def test_reconciled_rows_equal_anti_joins(spark, tmp_path, shares):
    rng = random.Random(1)
    common = rng.sample(range(10_000), 3000)
    a, b = listing(spark, [*common, *range(20_000, 20_150)]), listing(spark, [*common, *range(30_000, 30_090)], [(2024, "s", None, 5)])
    got = reconcile.reconcile(a, b, str(tmp_path / "w"), shares=shares)
    want = {("missing", *r) for r in map(tuple, diff.missing(a, b).select(*a.columns).collect())} | {("extra", *r) for r in map(tuple, listing(spark, range(30_000, 30_090), [(2024, "s", None, 5)]).collect())}
    assert {tuple(r) for r in got.collect()} == want


def test_shares_that_cannot_be_emptied_are_joined(spark, tmp_path):
    # one table for thousands of differences cannot be emptied
    a, b = listing(spark, range(0, 4000)), listing(spark, range(1500, 5500))
    got = reconcile.reconcile(a, b, str(tmp_path / "w"), shares=1)
    assert {r.side for r in spark.read.parquet(str(tmp_path / "w" / "difference")).collect()} == {0}
    assert got.where("side = 'missing'").count() == 1500 and got.where("side = 'extra'").count() == 1500
    assert reconcile.reconcile(a, a, str(tmp_path / "v")).count() == 0
    assert reconcile.reconcile(a.limit(0), a, str(tmp_path / "u")).count() == 4000
    twice = a.unionByName(a.where("size_bytes < 10"))
    assert reconcile.reconcile(twice, a.where("size_bytes >= 5"), str(tmp_path / "t")).count() == 10


def test_estimates_follow_the_difference(spark):
    a = reconcile.keyed(listing(spark, range(20_000)), ["year", "slug", "rel"]).select("a", "b")
    for n in (0, 1, 30, 5000):
        b = reconcile.keyed(listing(spark, range(n, 20_000)), ["year", "slug", "rel"]).select("a", "b")
        assert 0.4 * n <= reconcile.estimated_difference(a, b) <= max(2.5 * n, 2)


def test_hash_in_tasks_is_the_hash_of_the_engine(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(50)] + [(0, 0), (-1, 1)]
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("c", F.xxhash64("a", "b")).collect():
        assert reconcile.check_of(r.a, r.b) == r.c


def test_year_ranges(spark):
    bounds = [(0, 0), (1997, 0), (0, 1996), (2000, 2000), (1990, 2010), (2011, 1999), (1, 1), (16383, 0), (1024, 2047), (None, None), (3, 20_000)]
    years = [1, 2, 3, 1023, 1024, 1990, 1996, 1997, 2000, 2010, 2011, 2047, 2048, 16383]
    loc = spark.createDataFrame([(k, f"L{k}", "cold", None, a, b, True, 0, 0) for k, (a, b) in enumerate(bounds)], locs(spark).schema)
    coll = spark.createDataFrame([(y, f"s{y}") for y in years], "year int, slug string")
    got = sorted((r.year, r.dst) for r in locations.scope(coll, loc).collect())
    want = sorted((y, f"L{k}") for y in years for k, (a, b) in enumerate(bounds) if (not a or y >= a) and (not b or y <= b))
    assert got == want
    many = spark.range(10_050).selectExpr("CAST(id AS INT) AS ord", "concat('N', id) AS name", "'cold' AS role", "true AS pull", "CAST(1990 + id % 40 AS INT) AS year_from", "CAST(1995 + id % 50 AS INT) AS year_to", "true AS mounted", "0L AS avail_bytes", "0L AS total_bytes")
    plan = locations.scope(coll, many)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_damage_names_the_chunks(spark):
    schema = "year int, slug string, rel string, location string, chunk_no int, content binary"
    rows_ = [(2024, "a", f, loc, k, bytearray(f"{f}{k}".encode())) for f in "xyz" for loc in ("C1", "C2", "C3") for k in range(40)]
    change = {("x", "C2", 7): b"bad", ("y", "C2", 39): None, ("z", "C3", 0): b""}
    rows_ = [(*r[:5], bytearray(change.get((r[2], r[3], r[4]), bytes(r[5])) or b"")) for r in rows_ if change.get((r[2], r[3], r[4]), 1) is not None] + [(2024, "a", "z", "C2", 40, bytearray(b"more"))]
    tree = fixity.digest_tree(fixity.chunk_digests(spark.createDataFrame(rows_, schema)), levels=3, fanout=4).cache()
    found = fixity.damaged_chunks(diff.at(tree, "C1").drop("location"), tree.where("location <> 'C1'"), levels=3, fanout=4)
    assert rows(found, "rel", "location", "chunk_no", "problem") == [("x", "C2", 7, "differs"), ("y", "C2", 39, "missing"), ("z", "C2", 40, "extra"), ("z", "C3", 0, "differs")]
    assert rows(fixity.repair_plan(found, "C1"), "rel", "dst", "chunk_no", "action") == [("x", "C2", 7, "copy"), ("y", "C2", 39, "copy"), ("z", "C2", 40, "drop"), ("z", "C3", 0, "copy")]
    one = tree.where("level = 3").groupBy("rel").agg(F.count_distinct("digest").alias("n"))
    assert rows(one, "rel", "n") == [("x", 2), ("y", 2), ("z", 3)]


def test_shapes_of_a_map(spark, tmp_path):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(37)]
    loop = [(f"l{k}", f"l{(k + 1) % 5}") for k in range(5)]
    moves = [*chain, *loop, ("s", "t"), ("t", "s"), ("in", "l2"), ("m1", "m"), ("m2", "m"), ("same", "same")]
    path_map = spark.createDataFrame([(2024, a, b) for a, b in moves] + [(2023, "c1", "z")], "year int, slug string, new_slug string")
    got = {(r.year, r.slug): (r["shape"], r["last"], r["steps"]) for r in organise.map_shapes(path_map, str(tmp_path / "w")).collect()}
    assert got[2024, "c0"] == ("chain", "c37", 37) and got[2024, "c36"] == ("chain", "c37", 1) and got[2023, "c1"] == ("chain", "z", 1)
    assert {got[2024, f"l{k}"] for k in (0, 2, 3, 4)} == {("cycle", None, None)} and got[2024, "l1"] == got[2024, "in"] == ("merge", None, None)
    assert got[2024, "s"] == got[2024, "t"] == ("cycle", None, None)
    assert got[2024, "m1"] == got[2024, "m2"] == ("merge", "m", 1) and (2024, "same") not in got


def test_merged_collections_do_not_share_keys(spark):
    i = inv(spark, ("001_a", "H1", "x.jpg", 1), ("002_b", "H1", "x.jpg", 2), ("002_b", "H1", "y.jpg", 2), ("003_c", "H1", "x.jpg", 3))
    m = man(spark, ("003_c", "H1", "x.jpg", "d"))
    into = spark.createDataFrame([(2024, "001_a", "002_b")], "year int, slug string, new_slug string")
    assert rows(organise.map_collisions(i, into), "slug", "rel", "n") == [("002_b", "x.jpg", 2)]
    with pytest.raises(PySparkException, match="1 keys would belong to several files"):
        organise.apply_path_map(i, m, into)[0].collect()
    assert rows(organise.apply_path_map(i, m, into, "number")[0], "slug", "rel") == [("002_b", "x.jpg"), ("002_b", "x_2.jpg"), ("002_b", "y.jpg"), ("003_c", "x.jpg")]
    assert organise.apply_path_map(i, m, into, "keep")[0].count() == 4
    moved, left = organise.apply_path_map(i.where("slug <> '001_a'"), m, into)
    assert moved.count() == 3 and left.count() == 1


def test_long_numbers_in_names(spark):
    from fixity_spark.operators import numbering

    names = ["a.jpg", "d/a.jpg", "a_9223372036854775807.jpg", "e/a.jpg", "a_99999999999999999999999999.jpg"]
    got = [r.new_name for r in numbering.unique_names(spark.createDataFrame([("t", n, n.split("/")[-1]) for n in names], "target string, rel string, new_name string"), ["target"], "new_name").collect()]
    assert len(set(got)) == 5 and "a_100000000000000000000000000.jpg" in got


def test_copies_agree_with_recorded_digests(spark, tmp_path):
    import hashlib

    content = spark.createDataFrame([("H1", 2024, "a", r, bytearray(r.encode())) for r in "xy"], "location string, year int, slug string, rel string, content binary")
    plan = spark.createDataFrame([(2024, "a", "H1", "C1", r, 1) for r in "xy"], "year int, slug string, src string, dst string, rel string, size_bytes long")
    good = man(spark, *(("a", "H1", r, hashlib.sha256(r.encode()).hexdigest()) for r in "xy")).withColumn("algo", F.lit("sha256"))
    merged = transfer.execute_plan(plan, content, good, str(tmp_path / "t"))
    assert rows(merged, "location", "rel", "algo") == [("C1", "x", "sha256"), ("C1", "y", "sha256"), ("H1", "x", "sha256"), ("H1", "y", "sha256")]
    rotten = good.withColumn("digest", F.when(F.col("rel") == "x", "0" * 64).otherwise(F.col("digest")))
    with pytest.raises(RuntimeError, match="1 copies"):
        transfer.execute_plan(plan, content, rotten, str(tmp_path / "u"))
    other = rotten.withColumn("algo", F.lit("blake3"))
    assert transfer.execute_plan(plan, content, other, str(tmp_path / "v")).where("location = 'C1'").count() == 2
    assert transfer.drop_staged(spark, str(tmp_path / "u")) == 0 and transfer.drop_staged(spark, str(tmp_path / "u"), 0) == 1
    assert not list((tmp_path / "u" / "staged").iterdir()) and transfer.drop_staged(spark, str(tmp_path / "none"), 0) == 0


def test_outcomes_of_a_sync(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("b", "H1", "x", 1), ("b", "H2", "x", 2), ("c", "H1", "x", 1), ("c", "C1", "x", 1), ("c", "C2", "x", 1))
    m = man(spark, ("a", "H1", "gone", "d"))
    got = rows(transfer.sync_outcomes(i, m, locs(spark)), "slug", "n_diff", "n_ghosts", "n_files", "state")
    assert got == [("a", 0, 1, 2, "ghosts"), ("b", 2, 0, 0, "conflict"), ("c", 0, 0, 0, "ok")]


def test_damage_of_files_of_one_chunk(spark, sf_dir, tmp_path):
    """A file of one chunk that loses it and gains another one: what the query makes of it is what its SQL says."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from compare import TABLES, both

    import fixity_spark.queries_sets  # noqa: F401 (registers more)
    from fixity_spark.queries import ORACLES, QUERIES

    for name in TABLES:
        if name != "documents":
            os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    ids = [d for d in range(400_000) if d % 53 == 7 and d % 59 == 3]  # some of them are harmed, too
    rows = [(d, "short" if k % 2 else "long " * 100, "web") for k, d in enumerate(ids)] + [(60, "short", "web"), (62, "short", "web"), (97, "", "web")]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "documents.parquet")
    ours, theirs = both(spark, str(tmp_path), QUERIES["damaged_chunks"], ORACLES["damaged_chunks"])
    assert ours == theirs and len(ours) > len(ids)


@pytest.mark.parametrize("name", ["evict_backups", "build_manifests"])
def test_rows_of_views_are_dealt_by_path_once(spark, sf_dir, name):
    """The files are shuffled by path; the rows that locations list and record of them are not shuffled by path again."""
    from fixity_spark.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line and "rel#" in line.split("hashpartitioning(")[1].split(")")[0]]
    assert dealt and all("hashpartitioning(rel#" in line for line in dealt)


def test_listings_that_differ_much_make_no_tables(spark, tmp_path):
    a, b = listing(spark, range(0, 4000), [(2024, "s", None, 5), (2024, "s", None, 6), (2024, "t", None, 1)]), listing(spark, range(1500, 5500), [(2024, "t", None, 2)])
    got = reconcile.reconcile(a, b, str(tmp_path / "w"))
    assert not (tmp_path / "w").exists()
    want = {("missing", n) for n in range(1500)} | {("extra", n) for n in range(4000, 5500)}
    assert {(r.side, r.size_bytes) for r in got.where("rel IS NOT NULL").collect()} == want and got.count() == 3002
    assert sorted((r.side, r.size_bytes) for r in got.where("rel IS NULL").collect()) == [("missing", 5), ("missing", 6)]
    assert reconcile.reconcile(a, a.where("size_bytes <> 7"), str(tmp_path / "v")).count() == 1 and (tmp_path / "v" / "difference").exists()


def test_names_that_many_files_bear_are_numbered_in_ranges(spark, monkeypatch):
    from fixity_spark.operators import numbering

    rng = random.Random(3)
    files = [(t, f"d{k:04d}/{n}", n) for t in ("s", "t", None) for k in range(300) for n in (rng.choice(["a.jpg", "a.jpg", "a_7.jpg", f"b{k}.jpg"]),)]
    df = spark.createDataFrame(rng.sample(files, len(files)), "target string, rel string, new_name string").repartition(5)
    named = lambda: {(r.target, r.rel): r.new_name for r in numbering.unique_names(df, ["target"], "new_name").collect()}
    plain = named()
    monkeypatch.setattr(numbering, "CROWD", 20)
    monkeypatch.setattr(numbering, "RANGE", 30)
    got = named()
    assert got == plain and len(got) == len(files) and len({(t, n) for (t, _), n in got.items()}) == len(files)
    # no task numbers all rows of such a name: they lie in several ranges
    kept, write = [], numbering.written
    monkeypatch.setattr(numbering, "written", lambda df, name: (write(df, name), kept.append(name))[0] if name != "ranges" else kept.append(write(df, name)) or kept[-1])
    named()
    spread = kept[-1].where("new_name = 'a.jpg' AND target = 's'").select((F.col("_place") / (1 << 33)).cast("int").alias("r")).groupBy("r").count()
    assert spread.count() > 1
