"""What is shuffled: rows of files that lie dealt by path, and rows that a small table tells apart, stay where they are."""

import pytest

from fixity_spark.operators import diff, reporting
from fixity_spark.queries import QUERIES

LINES = "year int, slug string, rel string, location string, ord int, role string, digest string"
FILES = "year int, slug string, rel string, location string, ord int, role string, size_bytes long"


def dealt(df):
    """The keys of a plan's shuffles, without the numbers of columns."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#[0-9L]+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), [0-9]+\)", plan)]


@pytest.mark.parametrize("name", ["collection_scan", "coverage_state"])
def test_files_meet_their_lines_without_a_further_shuffle(spark, sf_dir, name):
    keys = dealt(QUERIES[name](spark, sf_dir))
    assert keys and all(k == "rel" for k in keys if "rel" in k)


def test_stale_manifests_do_not_meet_the_manifests(spark, sf_dir):
    keys = dealt(QUERIES["stale_manifests"](spark, sf_dir))
    assert keys == ["rel"]


def test_lines_said_twice_count_once(spark):
    inv = spark.createDataFrame([(2024, "a", "x", "H1", 0, "hot", 5), (2024, "a", "y", "H1", 0, "hot", 7), (None, None, "z", "H1", 0, "hot", 1)], FILES)
    man = spark.createDataFrame([(2024, "a", "x", "H1", 0, "hot", "d"), (2024, "a", "x", "H1", 0, "hot", "d"), (2024, "a", "y", "H1", 0, "hot", ""), (2024, "a", "gone", "H1", 0, "hot", "d"), (None, None, "z", "H1", 0, "hot", "d")], LINES)
    want = {("a", 12, 2, False), (None, 1, 1, False)}
    assert {(r.slug, r.bytes, r.files, r.checksummed) for r in reporting.collection_scan(inv, man).collect()} == want
    assert {(r.slug, r.files, r.uncovered) for r in diff.coverage(inv.drop("ord"), man).collect()} == {("a", 2, 1), (None, 1, 1)}


def test_merging_what_was_merged_needs_no_further_shuffle(spark, sf_dir):
    assert set(dealt(QUERIES["merged_twice"](spark, sf_dir))) == {"rel"}


@pytest.mark.parametrize("name", ["evict_gate", "evict_gate_unverified", "evict_gate_strict"])
def test_gates_take_files_where_they_lie(spark, sf_dir, monkeypatch, name):
    from fixity_spark.plans import retain

    keys, keep = {}, retain._kept
    monkeypatch.setattr(retain, "_kept", lambda df, work, name: (keys.setdefault(name, dealt(df)), keep(df, work, name))[1])
    QUERIES[name](spark, sf_dir)
    assert {"chosen", "targets", "alike", "open", "judged"} <= set(keys)
    assert not [k for of in keys.values() for k in of if "rel" in k]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_more_files_make_more_parts_not_larger_ones(spark, sf_dir, monkeypatch):
    from compare import both

    from fixity_spark import fixtures
    from fixity_spark.queries import ORACLES, Tables

    monkeypatch.setattr(fixtures, "FILES_PER_TASK", 700)
    files, parts = fixtures.files_dealt(spark, sf_dir)
    sizes = [sum(1 for _ in rows) for rows in files.rdd.glom().collect()]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert parts == len(sizes) == -(-lines // 700) and max(sizes) < 1000
    assert Tables(spark, sf_dir, sized=True).manifest.groupBy("rel").count().rdd.getNumPartitions() == parts
    ours, theirs = both(spark, sf_dir, QUERIES["evict_gate_unverified"], ORACLES["evict_gate_unverified"])
    assert ours == theirs


def test_manifests_read_back_meet_the_files_where_both_are_dealt(spark, sf_dir, monkeypatch):
    from compare import both

    from fixity_spark import queries_sets
    from fixity_spark.queries import ORACLES

    keys = dealt(QUERIES["evict_from_files"](spark, sf_dir))
    paths = [k for k in keys if "rel" in k]
    assert set(paths) == {"year, slug, rel"} and len(paths) == 7  # the files, and the manifests of six locations
    monkeypatch.setattr(queries_sets, "FILES_PER_TASK", 20)  # manifests of several files
    made, text = [], queries_sets.move
    monkeypatch.setattr(queries_sets, "move", lambda spark, old, new: (text(spark, old, new), made.append(len([n for n in queries_sets.folders(spark, new) if n.endswith(".gz")]))))
    ours, theirs = both(spark, sf_dir, QUERIES["evict_from_files"], ORACLES["evict_from_files"])
    assert ours == theirs and max(made) > 1


def test_digests_of_any_form_come_back_as_they_were(spark, tmp_path):
    from fixity_spark.sources import io

    digests = ["ab12" * 16, "AB12" * 16, "ab1", "", "sha1:ab", "é", "0a" * 20_000]
    folder = tmp_path / "2024" / "001_a"
    folder.mkdir(parents=True)
    (folder / "checksums.b3").write_text("".join(f"{d}  f{k}  x.mov\n" for k, d in enumerate(["other", *digests[1:]])) + f"{digests[0]}  f0  x.mov\nno line\n", encoding="utf-8")
    read = io.read_manifests(spark, f"{tmp_path}/*/*/*", "A", parts=3)
    assert read.rdd.getNumPartitions() == 3
    got = read.collect()
    assert sorted((r.year, r.slug, r.rel, r.location, r.digest) for r in got) == [(2024, "001_a", f"f{k}  x.mov", "A", d) for k, d in enumerate(digests)]
