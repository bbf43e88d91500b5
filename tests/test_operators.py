import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixity_spark.operators import diff, fixity, locations, numbering, reporting, selection
from fixity_spark.plans import ingest, manifests, organise, retain, transfer

INV = "year int, slug string, location string, ord int, role string, rel string, size_bytes long"
MAN = "year int, slug string, location string, ord int, role string, rel string, digest string"
ORDS = {"H1": (0, "hot"), "H2": (1, "hot"), "H3": (2, "hot"), "C1": (3, "cold"), "C2": (4, "cold")}


def inv(spark, *rows):
    return spark.createDataFrame([(2024, slug, loc, *ORDS[loc], rel, size) for slug, loc, rel, size in rows], INV)


def man(spark, *rows):
    return spark.createDataFrame([(2024, slug, loc, *ORDS[loc], rel, digest) for slug, loc, rel, digest in rows], MAN)


def locs(spark):
    return spark.createDataFrame([(o, n, r, None, 0, 0, True, 100, 1000) for n, (o, r) in ORDS.items()], "ord int, name string, role string, pull boolean, year_from int, year_to int, mounted boolean, avail_bytes long, total_bytes long")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_coverage_states(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "H1", "checksums.b3", 1), ("b", "H1", "x", 1), ("b", "H1", "y", 1), ("c", "H1", "x", 1), ("d", "H1", "checksums.b3", 9))
    m = man(spark, ("a", "H1", "x", "d"), ("b", "H1", "x", "d"), ("c", "H1", "x", ""), ("e", "H1", "x", "d"))
    assert rows(diff.coverage(i, m), "slug", "files", "uncovered", "covered") == [("a", 1, 0, True), ("b", 2, 1, False), ("c", 1, 1, False)]


def test_missing_is_extra_reversed(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "H1", "y", 1), ("a", "C1", "y", 2), ("a", "C1", "z", 1))
    a, b = diff.at(i, "H1"), diff.at(i, "C1")
    assert rows(diff.missing(a, b), "rel") == rows(diff.extra(b, a), "rel") == [("x",)]


def test_listing_diff_sees_empty_files(spark):
    i = inv(spark, ("a", "H1", "x", 0), ("a", "H2", "y", 0), ("b", "H1", "x", 1), ("b", "H2", "x", 1), ("c", "H1", "x", 1), ("c", "H2", "x", 2))
    assert rows(diff.listing_diff(diff.at(i, "H1"), diff.at(i, "H2")), "slug", "n_diff") == [("a", 2), ("c", 2)]


def test_self_entries_do_not_count(spark):
    m = man(spark, ("a", "H1", "checksums.b3", "d"), ("a", "H1", "gone", "d"))
    assert rows(diff.ghosts(inv(spark, ("a", "H1", "x", 1)), m), "rel") == [("gone",)]


def test_fullest_ties_go_to_order(spark):
    i = inv(spark, ("a", "C1", "x", 1), ("a", "C2", "x", 1), ("b", "C1", "x", 1), ("b", "C2", "x", 1), ("b", "C2", "y", 1))
    assert rows(selection.pick_fullest(selection.copies(i), "cold"), "slug", "location") == [("a", "C1"), ("b", "C2")]


def test_agreed_copies(spark):
    i = inv(spark, *(("a", h, "x", 1) for h in ("H1", "H2")), *(("b", h, "x", 1) for h in ("H1", "H2")), ("b", "H3", "x", 2), ("c", "H1", "x", 1), ("c", "H2", "x", 1), ("c", "H2", "y", 1), ("d", "H3", "x", 1))
    assert rows(selection.pick_agreed(i), "slug", "location") == [("a", "H1"), ("d", "H3")]


def test_first_n(spark):
    b = inv(spark, ("a", "C1", "x", 1), ("a", "C2", "x", 1), ("b", "C2", "x", 1))
    assert rows(selection.first_n(b, 2), "slug", "location", "enough") == [("a", "C1", True), ("a", "C2", True), ("b", "C2", False)]
    assert rows(selection.first_n(b, 1), "slug", "location", "enough") == [("a", "C1", True), ("b", "C2", True)]


def test_numbers_resolve_in_location_order(spark):
    c = spark.createDataFrame([(2023, "007_old", 0), (2024, "7_b", 1), (2024, "007_z", 1), (2024, "007_x", 2)], "year int, slug string, ord int")
    want = spark.createDataFrame([(2024, 7)], "year int, num int")
    assert rows(selection.resolve_number(c, want), "year", "slug") == [(2024, "007_z")]
    assert rows(selection.resolve_number(c.where("year = 2023"), want, across_years=True), "year", "slug") == [(2023, "007_old")]


def test_renumber(spark):
    c = spark.createDataFrame([(2024, s) for s in ("003_a", "005_b", "005_a", "000_Edits", "x")], "year int, slug string")
    plan = numbering.renumber_plan(c)
    assert rows(plan, "slug", "new_slug") == [("003_a", "001_a"), ("005_a", "002_a"), ("005_b", "003_b")]
    done = c.join(plan, ["year", "slug"], "left").select("year", F.coalesce("new_slug", "slug").alias("slug"))
    assert numbering.renumber_plan(done).count() == 0
    assert rows(organise.renumber_plan(c)[1], "last_num") == [(3,)]


def test_collisions(spark):
    names = ["a/x.mp4", "b/x.mp4", "a_b/y", "a/b_y", "c/b_y", "q/z.mp4", "q_z.mp4", "p/z.mp4"]
    files = spark.createDataFrame([("t", n) for n in names], "target string, rel string")
    got = {r.rel: r.new_name for r in numbering.resolve_collisions(files, ["target"]).collect()}
    assert len(set(got.values())) == len(names)
    assert got["a/x.mp4"] == "a_x.mp4" and got["b/x.mp4"] == "b_x.mp4"
    assert {got["q/z.mp4"], got["q_z.mp4"]} == {"q_z.mp4", "q_z_2.mp4"}


def test_names_that_others_bear(spark):
    chains = [["d/a.jpg", "e/a.jpg", "q/d_a.jpg", "q/d_a_2.jpg", "q/d_a_2_2.jpg"], ["a/b.jpg", "a_b.jpg", "a_b_2.jpg", "a_b_7.jpg"], ["x/n", "x_n", "y/n", "y_n_999999999999999999999"]]
    files = spark.createDataFrame([(str(k), n) for k, names in enumerate(chains) for n in names], "target string, rel string")
    for made in (numbering.resolve_collisions(files, ["target"]), organise.unsorted_names(files.withColumnsRenamed({"target": "location"}).withColumn("year", F.lit(1))).withColumnRenamed("location", "target")):
        got = [(r.target, r.new_name) for r in made.collect()]
        assert len(set(got)) == len(got) == 13


def test_swap_of_slugs(spark):
    i = inv(spark, ("001_a", "H1", "x", 1), ("002_b", "H1", "y", 1), ("003_c", "H1", "z", 1))
    m = man(spark, ("001_a", "H1", "x", "d"), ("003_c", "H1", "z", "d"))
    swap = spark.createDataFrame([(2024, "001_a", "002_b"), (2024, "002_b", "001_a")], "year int, slug string, new_slug string")
    moved, left = organise.apply_path_map(i, m, swap)
    assert rows(moved, "slug", "rel") == [("001_a", "y"), ("002_b", "x"), ("003_c", "z")]
    assert rows(left, "slug") == [("003_c",)]


def test_counters(spark):
    seen = spark.createDataFrame([(2023, 5), (2024, 2), (2025, 1)], "year int, max_num int")
    held = spark.createDataFrame([(2023, 3), (2024, 9)], "year int, last_num int")
    assert rows(numbering.reconcile_counters(seen, held), "year", "new_num") == [(2023, 5), (2024, 9), (2025, 1)]
    assert rows(numbering.reconcile_counters(seen, held, exact=True), "year", "new_num") == [(2023, 5), (2024, 2), (2025, 1)]
    assert rows(numbering.peek(held), "next_num") == [(4,), (10,)]
    assert rows(numbering.step(spark.createDataFrame([(2023, 0), (2024, 9)], "year int, last_num int"), [2023, 2024], -1), "last_num") == [(0,), (8,)]


def test_season_numbers(spark):
    seasons = spark.createDataFrame([(2024, s) for s in ("Winter", "Spring", "Summer")], "year int, season string")
    counters = spark.createDataFrame([(2024, 2)], "year int, last_num int")
    assert rows(numbering.season_slugs(seasons, counters, inv(spark, ("004_a", "H1", "x", 1))), "slug") == [("005_Spring",), ("006_Summer",), ("007_Winter",)]


def test_retention(spark):
    i = inv(spark, *((s, h, "x", 1) for s in "abcdef" for h in ("H1",)), *((s, "C1", "x", 1) for s in "acdf"), ("b", "C1", "other", 1), ("f", "C2", "x", 1))
    m = man(spark, *((s, "H1", "x", "d") for s in "abcdef"), ("a", "C1", "x", "d"), ("b", "C1", "x", "d"), ("c", "C1", "x", "bad"), ("f", "C1", "x", "d"), ("f", "C2", "x", "d"))
    got = {r.slug: (r.n_qualifying, r.reasons, r.releasable) for r in retain.verdict(i, m, 1).collect()}
    assert got == {
        "a": (1, "", True),
        "b": (0, "C1: missing 1 files", False),
        "c": (0, "C1: 1 different digests", False),
        "d": (0, "C1: no manifest", False),
        "e": (0, "no cold copy", False),
        "f": (2, "", True),
    }
    targets, chosen = retain.evict_plan(i, m, 1)
    assert rows(targets, "slug") == [("a",), ("f",)] and rows(chosen, "slug", "location") == [("a", "C1"), ("f", "C1")]
    good = m.select("year", "slug", "rel", "location", "digest")
    bad = good.withColumn("digest", F.when((F.col("slug") == "f") & (F.col("location") == "C1"), "rot").otherwise(F.col("digest")))
    assert rows(retain.evict_gate(targets, chosen, m, fixity.verify(m, good)), "slug", "passed") == [("a", True), ("f", True)]
    assert rows(retain.evict_gate(targets, chosen, m, fixity.verify(m, bad)), "slug", "passed") == [("a", False), ("f", False)]
    assert rows(retain.evict_gate(targets, chosen, m, fixity.verify(m, bad), strict=False), "slug", "passed") == [("a", True), ("f", False)]
    none = fixity.verify(m, good).limit(0)
    assert rows(retain.evict_gate(targets, chosen, m, none), "slug", "passed") == [("a", False), ("f", False)]
    some = fixity.verify(m, good).where("slug <> 'f'")
    assert rows(retain.evict_gate(targets, chosen, m, some, strict=False), "slug", "n_failed", "passed") == [("a", 0, True), ("f", 1, False)]
    assert rows(retain.evict_gate(targets, chosen.where("slug = 'a'"), m, some, strict=False), "slug", "passed") == [("a", True), ("f", False)]
    assert rows(retain.evict_gate(targets, chosen, quick=True), "slug", "passed") == [("a", True), ("f", True)]
    with pytest.raises(ValueError):
        retain.evict_gate(targets, chosen)
    with pytest.raises(ValueError):
        retain.evict_gate(targets, chosen, verified=some)
    assert rows(retain.evict_plan(i, m, 1, hot=["H2"])[0], "slug") == []
    assert rows(retain.evict_plan(i, m, 1, hot=[" h1 "])[0], "slug") == [("a",), ("f",)]


@pytest.mark.parametrize("written", [False, True])
def test_gate_needs_the_very_lines(spark, tmp_path, written):
    work = str(tmp_path / "w") if written else None
    i = inv(spark, *(("a", loc, f, 1) for loc in ("H1", "C1") for f in "xy"), ("b", "H1", "x", 1), ("b", "C1", "x", 1))
    m = man(spark, *(("a", loc, f, "d") for loc in ("H1", "C1") for f in "xy"), ("b", "C1", "x", "d"))
    targets, chosen = retain.evict_plan(i, m, 1, work=work)
    said = lambda *rows: spark.createDataFrame([(2024, slug, "C1", rel, status) for slug, rel, status in rows], "year int, slug string, location string, rel string, status string")
    gate = lambda *rows: sorted((r.slug, r.n_failed, r.passed) for r in retain.evict_gate(targets, chosen, m, said(*rows), strict=False, work=work).collect())
    b = ("b", "x", "ok")
    assert gate(("a", "x", "ok"), ("a", "y", "ok"), b) == [("a", 0, True), ("b", 0, True)]
    assert gate(("a", "x", "ok"), ("a", "zzz", "ok"), b) == [("a", 1, False), ("b", 0, True)]  # another file instead
    assert gate(("a", "x", "ok"), ("a", "x", "ok"), b) == [("a", 1, False), ("b", 0, True)]  # one line twice
    assert gate(("a", "x", "ok"), ("a", "y", "ok"), ("a", "y", "ok"), ("a", "zzz", "mismatch"), b) == [("a", 0, True), ("b", 0, True)]
    assert gate(("a", "x", "ok"), ("a", "y", "ok"), ("a", "y", "mismatch"), b) == [("a", 1, False), ("b", 0, True)]
    assert gate(("a", "x", "ok"), ("a", "y", None), b) == [("a", 1, False), ("b", 0, True)]
    stale = fixity.verify(m, m.select("year", "slug", "rel", "location", "digest")).withColumn("digest", F.lit("older"))
    assert {r.passed for r in retain.evict_gate(targets, chosen, m, stale, work=work).collect()} == {False}


def test_missing_columns_are_refused(spark):
    from fixity_spark.plans import check

    i, m = inv(spark, ("a", "H1", "x", 1), ("a", "C1", "x", 1)), man(spark, ("a", "H1", "x", "1"), ("a", "C1", "x", "2"))
    with pytest.raises(ValueError, match="role"):
        retain.verdict(i, m.drop("role"), 1)
    with pytest.raises(ValueError, match="ord"):
        check.findings(i.drop("ord"), m, locs(spark))
    named = [locations.with_location(df.drop("ord", "role"), locs(spark)) for df in (i, m)]
    assert rows(retain.verdict(*named, 1), "reasons", "releasable") == [("C1: 1 different digests", False)]
    assert rows(check.findings(*named, locs(spark)), "location", "kind") == [("C1", "conflict"), ("C2", "collection_missing")]
    with pytest.raises(PySparkException, match="unknown location: C1"):
        locations.with_location(i.drop("ord", "role"), locs(spark).where("name <> 'C1'")).collect()


def test_algorithms_are_kept_apart(spark):
    from fixity_spark.plans import check

    i = inv(spark, *((s, h, "x", 1) for s in "ab" for h in ("H1", "C1")))
    m = man(spark, *((s, h, "x", h) for s in "ab" for h in ("H1", "C1"))).withColumn("algo", F.when((F.col("slug") == "a") & (F.col("location") == "C1"), "blake3").otherwise("sha256"))
    one = locs(spark).where("name <> 'C2'")
    assert rows(check.findings(i, m, one), "slug", "kind") == [("b", "conflict")]
    assert rows(diff.manifest_conflicts(diff.at(m, "H1"), diff.at(m, "C1")), "slug") == [("b",)]
    assert rows(retain.verdict(i, m, 1), "slug", "reasons") == [("a", ""), ("b", "C1: 1 different digests")]
    merged = fixity.merge_manifest(m, m.where("slug = 'a'").withColumn("algo", F.lit("md5")))
    assert rows(merged, "slug", "location", "algo") == [("a", "C1", "md5"), ("a", "H1", "md5"), ("b", "C1", "sha256"), ("b", "H1", "sha256")]
    content = spark.createDataFrame([(2024, s, "x", "C1", bytearray(b"x")) for s in "ab"], "year int, slug string, rel string, location string, content binary")
    _, summary = manifests.verify(diff.at(m, "C1"), content)
    assert rows(summary, "slug", "n_failed", "n_other_algo", "state") == [("a", 0, 1, "unverified"), ("b", 1, 0, "failed")]
    computed = i.where("location = 'H1'").select("year", "slug", "rel", "location", F.lit("new").alias("digest"), F.lit("sha256").alias("algo"))
    built = manifests.build_manifests(i, m.where("location = 'C1'"), computed)
    assert rows(built, "slug", "state", "disputed") == [("a", "new", False), ("b", "new", True)]


def test_build_manifests(spark):
    i = inv(spark, *((s, h, "x", 1) for s in "abc" for h in ("H1", "C1")), ("c", "H1", "y", 1))
    computed = spark.createDataFrame([(2024, s, "x", h, "1" if s != "b" or h == "H1" else "2") for s in "abc" for h in ("H1", "C1")] + [(2024, "c", "y", "H1", "3")], "year int, slug string, rel string, location string, digest string")
    built = manifests.build_manifests(i, man(spark, ("z", "H1", "x", "d")), computed)
    assert rows(built, "slug", "rel", "state", "publish") == [("a", "x", "new", True), ("b", "x", "conflict", False), ("c", "x", "new", False), ("c", "y", "absent", False)]
    assert rows(manifests.new_manifest_rows(built, i, man(spark, ("z", "H1", "x", "d"))), "slug", "location", "digest") == [("a", "C1", "1"), ("a", "H1", "1")]


def test_disputed_digests(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "C1", "x", 1))
    computed = spark.createDataFrame([(2024, "a", "x", "H1", "1")], "year int, slug string, rel string, location string, digest string")
    for recorded, disputed in (("1", False), ("2", True)):
        assert rows(manifests.build_manifests(i, man(spark, ("a", "C1", "x", recorded)), computed), "state", "disputed") == [("new", disputed)]


def test_merge_twice_is_merge_once(spark):
    old = man(spark, ("a", "H1", "x", "1"), ("a", "H1", "y", "1"), ("a", "H1", "checksums.b3", "1"))
    new = man(spark, ("a", "H1", "x", "2"))
    once = fixity.merge_manifest(old, new)
    assert rows(once, "rel", "digest") == rows(fixity.merge_manifest(once, new), "rel", "digest") == [("x", "2"), ("y", "1")]


def test_verify_bulk_states(spark):
    m = man(spark, ("a", "C1", "x", hashlib.sha256(b"x").hexdigest()), ("a", "C1", "y", "bad"), ("a", "C1", "gone", "d"))
    content = spark.createDataFrame([(2024, "a", r, "C1", bytearray(r.encode())) for r in ("x", "y")], "year int, slug string, rel string, location string, content binary")
    checked, summary = manifests.verify(m, content, inv(spark, ("a", "C1", "x", 1), ("b", "C1", "x", 1)))
    assert rows(checked, "rel", "status") == [("gone", "unreadable"), ("x", "ok"), ("y", "mismatch")]
    assert rows(summary, "slug", "n_failed", "state") == [("a", 2, "failed"), ("b", 0, "no_manifest")]


def test_other_algorithms_are_not_compared(spark):
    m = spark.createDataFrame([(2024, "a", "x", "C1", "d", "blake3")], "year int, slug string, rel string, location string, digest string, algo string")
    c = spark.createDataFrame([(2024, "a", "x", "C1", bytearray(b"x"))], "year int, slug string, rel string, location string, content binary")
    assert rows(fixity.verify(m, fixity.digests(c)), "status") == [("other_algo",)]


@pytest.mark.parametrize("size", [0, 1, 1023, (4 << 20) - 1, 4 << 20, (4 << 20) + 1])
def test_digest_of_sizes(spark, size):
    data = bytes(size)
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert fixity.digests(df).first().digest == hashlib.sha256(data).hexdigest()


def test_chunked_digest(spark):
    parts = [b"one", b"two", b"three"]
    df = spark.createDataFrame([(2024, "a", "x", "C1", k, bytearray(p)) for k, p in reversed(list(enumerate(parts)))], "year int, slug string, rel string, location string, chunk_no int, content binary")
    want = hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    assert fixity.chunked_digests(df, 4).first().digest == want


def test_plans_leave_nothing_to_do(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "H1", "y", 1), ("a", "C1", "x", 1))
    plan = transfer.sync_plan(i, locs(spark))
    assert rows(plan, "dst", "rel") == [("C1", "y"), ("C2", "x"), ("C2", "y")]
    after = i.unionByName(plan.select("year", "slug", F.col("dst").alias("location"), F.when(F.col("dst") == "C1", 3).otherwise(4).alias("ord"), F.lit("cold").alias("role"), "rel", "size_bytes"))
    assert transfer.sync_plan(after, locs(spark)).count() == 0


def test_numbered_pull(spark):
    i = inv(spark, ("001_a", "C1", "d/x", 1), ("001_a", "C1", "y", 1), ("002_b", "C1", "d/x", 1))
    plan = transfer.pull_plan(i, locs(spark), [1], "d", ["h2"])
    assert rows(plan, "slug", "dst", "rel") == [("001_a", "H2", "d/x")]


def test_execute_plan(spark, tmp_path):
    content = spark.createDataFrame([("H1", 2024, "a", r, bytearray(r.encode())) for r in "xy"], "location string, year int, slug string, rel string, content binary")
    plan = spark.createDataFrame([(2024, "a", "H1", d, r, 1) for d in ("C1", "C2") for r in "xy"], "year int, slug string, src string, dst string, rel string, size_bytes long")
    merged = transfer.execute_plan(plan, content, man(spark, ("a", "C1", "x", "old")), str(tmp_path / "t"))
    assert rows(merged, "location", "rel", "digest") == sorted((d, r, hashlib.sha256(r.encode()).hexdigest()) for d in ("C1", "C2") for r in "xy")
    for state in (b"two", b"three"):
        merged = transfer.execute_plan(plan, content.withColumn("content", F.lit(state)), merged, str(tmp_path / "t"))
        assert {r.digest for r in merged.collect()} == {hashlib.sha256(state).hexdigest()}
    newest = transfer.copied(spark, str(tmp_path / "t"))
    assert newest.count() == 4 and {bytes(r.content) for r in newest.collect()} == {b"three"}
    assert not list((tmp_path / "t" / "staged").iterdir())
    lost = plan.unionByName(spark.createDataFrame([(2024, "a", "H1", "C1", "gone", 1)], plan.schema))
    with pytest.raises(RuntimeError):
        transfer.execute_plan(lost, content, man(spark, ("a", "C1", "x", "old")), str(tmp_path / "u"))
    assert not (tmp_path / "u" / "copied").exists()


def test_ingest_inherits_dates(spark):
    arrivals = spark.sql("SELECT 'K' AS card, 'Clip/A1.MXF' AS rel, 'A1' AS stem, 5L AS size_bytes, timestamp'2024-05-02 10:00:00' AS mtime UNION ALL SELECT 'L', 'Clip/A1.MXF', 'A1', 5L, timestamp'2024-05-02 10:00:00'")
    sidecars = spark.createDataFrame([("K", "A1M01.XML", '<CreationDate value="2024-05-01T0"/>')], "card string, name string, xml string")
    assert [(c, str(d)) for c, d in rows(ingest.assign_shot_day(arrivals, sidecars), "card", "day")] == [("K", "2024-05-01"), ("L", "2024-05-02")]


def test_check_summary_passes_empty(spark):
    from fixity_spark.plans import check

    i = inv(spark, ("a", "H1", "x", 1), ("a", "C1", "x", 1), ("a", "C2", "x", 1))
    found, summary = check.check(i, man(spark, ("a", "H1", "x", "1"), ("a", "C1", "x", "1")), locs(spark))
    assert found.count() == 0 and rows(summary, "slug", "passed") == [("a", True)]
    assert check.only_copies(i, locs(spark)).count() == 0


def test_check_tells_whole_collections_apart(spark):
    from fixity_spark.plans import check

    i = inv(spark, ("001_a", "H1", "x", 1), ("001_a", "C1", "x", 1), ("002_b", "C1", "x", 1), ("003_c", "C2", "x", 1))
    nothing = man(spark, ("z", "H1", "x", "1")).limit(0)
    found, summary = check.check(i, nothing, locs(spark))
    assert rows(found, "slug", "location", "kind") == [("001_a", "C2", "collection_missing"), ("002_b", "C2", "collection_missing"), ("003_c", "C1", "collection_missing")]
    assert rows(summary, "slug", "n_collection_missing", "passed") == [("001_a", 1, False), ("002_b", 1, False), ("003_c", 1, False)]
    alone = locs(spark).where("name <> 'C2'")
    assert rows(check.findings(i.where("slug <> '003_c'"), nothing, alone), "slug", "location", "kind") == [("002_b", "C1", "only_copy")]
    assert rows(check.check(i, nothing, locs(spark), numbers=[1, 9])[1], "slug") == [("001_a",)]


def test_reference_is_in_scope(spark):
    from fixity_spark.plans import check

    i = inv(spark, ("a", "C1", "x", 1), ("a", "C2", "x", 1), ("a", "C2", "y", 1), ("b", "C1", "x", 1))
    late = locs(spark).withColumn("year_from", F.when(F.col("name") == "C1", 2025).otherwise(0))
    assert rows(selection.pick_reference(selection.copies(i), late), "slug", "location") == [("a", "C2")]
    assert rows(check.findings(i, man(spark, ("a", "C2", "x", "1")), late), "slug", "location", "kind") == [("a", "C2", "only_copy")]
    assert rows(selection.pick_reference(selection.copies(i)), "slug", "location") == [("a", "C1"), ("b", "C1")]


def test_requests_that_lead_nowhere(spark):
    i = inv(spark, ("001_a", "C1", "d/x", 1), ("002_b", "H1", "d/x", 1), ("003_c", "C1", "y", 1))
    assert rows(transfer.unresolved(i, [1, 2, 3, 4], "d"), "num", "problem") == [(2, "no source"), (3, "no such folder"), (4, "unknown number")]


def test_room_of_locations(spark):
    from fixity_spark.operators import locations

    room = spark.createDataFrame([("H1", 5, 9)], "name string, avail_bytes long, total_bytes long")
    got = {r.name: (r.mounted, r.avail_bytes) for r in locations.with_room(locs(spark), room).collect()}
    assert got["H1"] == (True, 5) and got["C1"] == (False, 0)


def test_ghosts_of_sources(spark):
    i = inv(spark, ("a", "H1", "x", 1), ("a", "C1", "x", 1))
    m = man(spark, ("a", "H1", "x", "1"), ("a", "H1", "gone", "1"), ("a", "C1", "gone", "1"), ("b", "H1", "x", "1"))
    assert rows(transfer.sync_ghosts(i, m), "slug", "location", "n_ghosts") == [("a", "H1", 1)]


def test_capacity(spark):
    plan = spark.createDataFrame([("C1", 60), ("C1", 60), ("C2", 60)], "dst string, size_bytes long")
    totals = reporting.transfer_totals(plan, spark.createDataFrame([("C2", 7)], "dst string, size_bytes long"))
    assert rows(totals, "dst", "to_copy", "present") == [("C1", 120, 0), ("C2", 60, 7)]
    assert rows(reporting.capacity_check(totals, locs(spark)), "dst", "too_large") == [("C1", True), ("C2", False)]


def test_union_reference_sees_second_hot_copy(spark):
    from fixity_spark.plans import check

    i = inv(spark, ("a", "H1", "x", 1), ("a", "H2", "x", 1), ("a", "H2", "y", 1), ("a", "C1", "x", 1))
    m = man(spark, ("a", "H1", "x", "1"))
    one = locs(spark).where("name <> 'C2'")
    assert check.findings(i, m, one).count() == 0
    assert rows(check.findings(i, m, one, "union"), "location", "kind", "rel") == [("C1", "missing", "y")]
    with pytest.raises(ValueError):
        check.compare(i, locs(spark), "other")
