import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, In

from fixity_spark.sources import io
from fixity_spark.sources.tree import TreeReader, read_tree
from fixity_spark.sources.versioned import Refused, VersionedTable
from fixity_spark.streaming.ingest import ingest_incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "disk" / "2024"
    for name in ("001_a/CARD/x y.mxf", "001_a/CARD/Thumbs.db", "001_a/@eaDir/j", "001_a/checksums.b3", "002_b/z+1%.mov"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("abc")
    (root / "001_a/checksums.b3").write_text("d1  CARD/x y.mxf\nbroken\nd2  two  spaces\nd3  two  spaces\nd4  checksums.b3\n")
    return tmp_path / "disk"


def test_inventory(spark, tree):
    rows = io.read_inventory(spark, str(tree), "H1")
    assert sorted((r.year, r.slug, r.rel, r.size_bytes) for r in rows.collect()) == [(2024, "001_a", "CARD/x y.mxf", 3), (2024, "002_b", "z+1%.mov", 3)]
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_manifests(spark, tree):
    rows = io.read_manifests(spark, f"{tree}/2024/*/checksums.b3", "H1")
    assert sorted((r.slug, r.rel, r.digest) for r in rows.collect()) == [("001_a", "CARD/x y.mxf", "d1"), ("001_a", "two  spaces", "d3")]


def test_listing_table(spark):
    df = spark.createDataFrame([("a/b", 1), ("a/.b", 1), ("checksums.b3", 1)], "k string, n long")
    got = io.inventory_from_table(df, {"rel": "k", "size_bytes": "n"})
    assert [r.rel for r in got.collect()] == ["a/b"]
    assert io.inventory_from_table(df, {"rel": "k"}, keep_hidden=True).count() == 3


def test_locations(spark, tmp_path):
    p = tmp_path / "config.json"
    p.write_text(json.dumps({"other": 1, "drives": [{"volume": "A", "root": "R", "role": "hot", "pull": False}, {"path": "/data/Footage", "role": "cold", "year_from": 2020}]}))
    rows = io.read_locations(spark, str(p)).orderBy("ord").collect()
    assert [(r.ord, r.name, r.base, r.role, r.pull, r.year_from) for r in rows] == [(0, "A", "/Volumes/A", "hot", False, 0), (1, "Footage", "/data/Footage", "cold", None, 2020)]


def test_counters(spark, tmp_path):
    good, bad = tmp_path / "seq.json", tmp_path / "bad.json"
    good.write_text('{"2023": 5, "2024": 7}')
    bad.write_text('{"x": 5}')
    rows = io.read_counters(spark, str(good))
    assert sorted(tuple(r) for r in rows.collect()) == [(2023, 5), (2024, 7)]
    io.write_counters(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(PySparkException):
        io.read_counters(spark, str(bad)).collect()


def test_manifest_round_trip(spark, tmp_path):
    rows = [(2024, "001_a", "H1", "CARD/a  b.mxf", "d1"), (2024, "001_a", "H1", "z", "d0"), (2024, "002 b", "C1", "x", "d2"), (2024, "002 b", "C1", "checksums.b3", "d3")]
    io.write_manifests(spark.createDataFrame(rows, "year int, slug string, location string, rel string, digest string"), str(tmp_path / "m"))
    back = io.read_written_manifests(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows[:3])
    lines = next((tmp_path / "m").glob("year=2024/location=H1/slug=001_a/*.txt")).read_text().splitlines()
    assert lines == sorted(lines) == ["d0  z", "d1  CARD/a  b.mxf"]


def test_sidecars_and_probe(spark, tmp_path):
    (tmp_path / "A1M01.XML").write_text('<CreationDate value="2024-05-01T0"/>')
    row = io.read_sidecars(spark, f"{tmp_path}/*.XML", "K").first()
    assert (row.card, row.name) == ("K", "A1M01.XML")
    df = spark.createDataFrame([('{"format":{"tags":{"creation_time":"t"}}}',)], "out string")
    assert io.parse_probe(df, "out").first().probe.format.tags == {"creation_time": "t"}


def test_incremental_ingest(spark, tmp_path):
    schema = "year int, slug string, rel string, location string, size_bytes long"
    add = lambda rows: spark.createDataFrame([(2024, "a", r, "H1", 1) for r in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest_incremental(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    add(["x", "y", "y"])
    run()
    add(["y", "z"])
    run()
    run()
    assert sorted(r.rel for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["x", "y", "z"]


def test_a_manifest_in_many_tasks(spark, tmp_path):
    folder = tmp_path / "2024" / "001_a"
    folder.mkdir(parents=True)
    lines = [f"{k:064x}  CARD/{k % 700}.mxf" for k in range(20_000)]
    (folder / "checksums.b3").write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = io.read_manifests(spark, f"{tmp_path}/2024/*/checksums.b3", "H1")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        want = {line[66:]: line[:64] for line in lines}
        assert {r.rel: r.digest for r in rows.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_stream_state(spark, tmp_path):
    schema = "year int, slug string, rel string, location string, size_bytes long"
    add = lambda rows: spark.createDataFrame([(2024, "a", r, "H1", 1) for r in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda target="t": ingest_incremental(spark, str(tmp_path / "in"), schema, str(tmp_path / target), str(tmp_path / "c"))
    read = []
    for k in range(4):
        add([f"{k}-{j}" for j in range(50)] + ["0-0"])
        q = run()
        q.awaitTermination()
        read.append(q.lastProgress["numInputRows"])
    # a batch reads its own rows only, however much the target holds
    assert read == [51] * 4 and spark.read.parquet(str(tmp_path / "t")).count() == 200
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        run("other")
    with pytest.raises(ValueError):
        ingest_incremental(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c2"))


def test_tree_source(spark, tree):
    root = tree / "2023"
    for name in ("_unsorted/x.jpg", "_unsorted/.hidden/y.jpg", "003_c/@tmp/deep/junk.mov", "003_c/@eaDir/j", "003_c/CARD/._m", "003_c/CARD/ü 1%.mov"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("ab")
    (tree / "notes").mkdir()
    (tree / "notes" / "x").write_text("1")
    inv = read_tree(spark, str(tree), "H1")
    shown = {(2024, "001_a", "CARD/x y.mxf", 3), (2024, "002_b", "z+1%.mov", 3), (2023, "_unsorted", "x.jpg", 2), (2023, "003_c", "CARD/ü 1%.mov", 2)}
    assert {(r.year, r.slug, r.rel, r.size_bytes) for r in inv.collect()} == shown
    raw = {r.rel for r in read_tree(spark, f"file://{tree}", "H1", raw=True).where("year = 2023").collect()}
    assert raw == {"x.jpg", ".hidden/y.jpg", "@tmp/deep/junk.mov", "@eaDir/j", "CARD/._m", "CARD/ü 1%.mov"}
    reader = TreeReader({"path": str(tree), "location": "H1"})
    kept = list(reader.pushFilters([EqualTo(("year",), 2023), In(("slug",), ("003_c", "zzz")), EqualTo(("rel",), "x")]))
    assert [f.attribute for f in kept] == [("rel",)] and [p.folders for p in reader.partitions()] == [[(2023, "003_c")]]
    (root / "003_c" / "CARD").chmod(0)  # a folder that is not asked for is not entered
    try:
        assert inv.where("year = 2024").count() == 2
    finally:
        (root / "003_c" / "CARD").chmod(0o755)
    assert read_tree(spark, str(tree), "H1").where("year = 1999").count() == 0


SCHEMA = "year int, last_num int"


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["year"], ["year"])
    rows = lambda **kw: sorted(tuple(r) for r in t.read(**kw).collect())
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.version() == 0 and rows() == []
    assert t.merge(df((2023, 1), (2024, 5))) == 1
    assert t.merge(df((2024, 6))) == 2
    assert t.merge(df((2023, 0)), gone=True) == 3
    assert rows() == [(2024, 6)] and rows(as_of=1) == [(2023, 1), (2024, 5)] and rows(as_of=2) == [(2023, 1), (2024, 6)]
    before = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    assert t.compact() == 4 and rows() == [(2024, 6)] and rows(as_of=2) == [(2023, 1), (2024, 6)]
    assert t.merge(df((2025, 1))) == 5 and rows() == [(2024, 6), (2025, 1)]
    assert set(before) <= {p.name for p in (tmp_path / "t" / "data").iterdir()}
    with pytest.raises(ValueError):
        t.merge(df((2025, 1), (2025, 2)))


def test_two_writers(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["year"], ["year"]) for _ in range(2))
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    a.merge(df((2023, 1), (2024, 1)))
    up = lambda rows: rows.where("year = 2024").selectExpr("year", "last_num + 1 AS last_num")
    seen = b.version()
    mine = up(b.read(seen))
    a.update(up)
    with pytest.raises(Refused):
        b.replace(seen, mine)
    assert b.update(up) == 3  # looks again
    assert sorted(tuple(r) for r in a.read().collect()) == [(2023, 1), (2024, 3)]
    # another year is no conflict, whatever came between
    other = b.version()
    a.update(up)
    assert b.replace(other, df((2023, 7))) == 5
    assert sorted(tuple(r) for r in a.read().collect()) == [(2023, 7), (2024, 4)]
    # one number is given once
    run, touched = a._write(df((2024, 9)))
    a._commit(6, run, touched)
    with pytest.raises(Refused):
        b._commit(6, *b._write(df((2024, 10))))
    assert {r.last_num for r in b.read().where("year = 2024").collect()} == {9}


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["year"])
    t.merge(spark.createDataFrame([(2023, 1)], SCHEMA))
    t._write(spark.createDataFrame([(2023, 2)], SCHEMA))
    (tmp_path / "t" / "staged").mkdir(exist_ok=True)
    (tmp_path / "t" / "staged" / "half.json").write_text("{")
    again = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["year"])
    assert again.version() == 1 and [tuple(r) for r in again.read().collect()] == [(2023, 1)]


def test_sweep_removes_what_no_commit_names(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["year"])
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    runs = lambda: {p.name for p in (tmp_path / "t" / "data").iterdir()}
    t.merge(df((2023, 1)))
    t.merge(df((2024, 2)))
    dead, _ = t._write(df((2025, 9)))
    with pytest.raises(ValueError):
        t.merge(df((2026, 1), (2026, 2)))
    assert len(runs()) == 3  # a refused table leaves nothing
    assert t.sweep() == 0 and t.sweep(0) == 1 and dead not in runs() and len(runs()) == 2
    assert t.compact() == 3 and t.merge(df((2023, 5))) == 4
    assert [c["version"] for c in t._commits()] == [3, 4]  # what came before a whole version is not read
    for p in (tmp_path / "t" / "whole").iterdir():
        p.rmdir()  # as if compact had died before the mark
    want = [(2023, 5), (2024, 2)]
    assert sorted(map(tuple, t.read().collect())) == want and sorted(map(tuple, t.read(as_of=1).collect())) == [(2023, 1)]
    with pytest.raises(ValueError):
        t.sweep(0, keep_from=9)
    assert t.sweep(0, keep_from=4) == 2 and sorted(map(tuple, t.read().collect())) == want and t.read(as_of=3).count() == 2
    with pytest.raises(PySparkException):
        t.read(as_of=1).collect()


def test_dealt_runs_are_read_without_a_shuffle(spark, tmp_path):
    import re

    schema = "year int, rel string, location string, digest string"
    t = VersionedTable(spark, str(tmp_path / "t"), schema, ["year", "rel", "location"], ["year"], dealt=["rel"])
    df = lambda rels, digest, locations=("A", "B"): spark.createDataFrame([(2024, r, x, digest) for r in rels for x in locations], schema)
    names = [f"f{k}" for k in range(200)]
    t.merge(df(names, "one"))
    t.merge(df(names[50:], "two"))
    t.merge(df(names[100:120], None, ("B",)).drop("digest"), gone=True)
    want = {(2024, r, x, "one" if k < 50 else "two") for k, r in enumerate(names) for x in "AB" if x == "A" or not 100 <= k < 120}
    assert sorted(map(tuple, t.read().collect())) == sorted(want) and t.read(as_of=1).count() == 400
    assert t.compact() == 4 and sorted(map(tuple, t.read().collect())) == sorted(want)
    t.merge(df(names[110:130], "three", ("B",)))
    want = {w for w in want if not (w[2] == "B" and w[1] in names[110:130])} | {(2024, r, "B", "three") for r in names[110:130]}
    assert sorted(map(tuple, t.read().collect())) == sorted(want)
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and not re.search("Exchange", plan)
    with pytest.raises(ValueError):
        t.merge(df(["x", "x"], "d", ("A",)))
    # runs dealt otherwise, or not at all, are told apart too
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        t.merge(df(names[:10], "four"))
        assert t.read().where("digest = 'four'").count() == 20 and t.read().count() == len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    plain = VersionedTable(spark, str(tmp_path / "t"), schema, ["year", "rel", "location"], ["year"])
    plain.merge(df(names[:5], "five"))
    assert t.read().where("digest = 'five'").count() == 10 and t.read().count() == len(want)
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("fixity_")]
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "u"), schema, ["year", "rel"], dealt=["location"])
