import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixity_spark.functions import dates, paths, values


def each(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_junk_by_kind(spark):
    names = ["._a", ".a", "Thumbs.db", "@tmp", "@eaDir", "x@SynoResource", "desktop.ini", "a"]
    assert each(spark, names, lambda c: paths.is_junk(c, False)) == [True, False, True, False, False, True, True, False]
    assert each(spark, names, lambda c: paths.is_junk(c, True)) == [False, False, False, True, True, True, False, False]


def test_visible(spark):
    rels = ["a/b.mxf", "a/.h/b", ".a", "@tmp/x", "a/Thumbs.db", "Thumbs.db/a", "a/@eaDir", "a/b@SynoResource", "b@SynoResource/c"]
    assert each(spark, rels, paths.visible) == [True, False, False, False, False, True, True, False, False]


def test_manifest_paths_keep_dot_names(spark):
    assert each(spark, [".a", "a/.h/b", "@tmp/x", "a/._b", "a/@tmp"], paths.manifest_path_is_junk) == [False, False, True, True, False]


def test_numbers(spark):
    slugs = ["042_x", "42_x", "000_Edits", "+5_x", "x_1", "7", "2024_y"]
    assert each(spark, slugs, paths.is_numbered) == [True, True, False, True, False, False, True]
    assert each(spark, slugs, lambda c: paths.has_number(c, 42)) == [True, False, False, False, False, False, False]
    assert each(spark, ["2000", "2099", "2100", "1999", "abcd"], paths.is_year) == [True, True, False, False, False]


def test_selection(spark):
    assert each(spark, ["42", "42,44", "42-48", "42-44,48,43", " 7 ", "1-500"], paths.expand_selection) == [[42], [42, 44], list(range(42, 49)), [42, 43, 44, 48], [7], list(range(1, 501))]


@pytest.mark.parametrize("bad", ["9-7", "0", "1-501", "5-", "", "x"])
def test_selection_refuses(spark, bad):
    with pytest.raises(PySparkException):
        each(spark, [bad], paths.expand_selection)


def test_stems_and_names(spark):
    assert each(spark, ["923_0272M01.XML", "923_0272.MXF", "M1.XML", "noext"], paths.clip_stem) == ["923_0272", "923_0272", "", "noext"]
    assert each(spark, ["a/b/x.mp4", "x.mp4"], paths.flat_name) == ["a_b_x.mp4", "x.mp4"]
    assert each(spark, [" New Day "], lambda c: paths.slug(F.lit(7), c)) == ["007_New_Day"]
    assert each(spark, ["a/b/c.x"], paths.ancestors) == [["a", "a/b"]]
    assert each(spark, ["a/b/c.x.y", "n"], paths.extension) == [".y", ""]


def test_filename_dates(spark):
    names = ["2023-04-15", "2023_04-15", "x20230415", "120230415", "99999999_20230415", "20230231", "18991231", "d/none"]
    day = datetime.date
    # only the first match of a pattern is looked at
    assert each(spark, names, dates.filename_date) == [day(2023, 4, 15), day(2023, 4, 15), day(2023, 4, 15), None, None, day(2023, 3, 3), None, None]


def test_sidecar_dates(spark):
    assert each(spark, ['<m><CreationDate value="2023-04-15T1:0"/>', "<m/>", '<CreationDate value="20', '<CreationDate value="not a date"'], dates.sidecar_date) == [datetime.date(2023, 4, 15), None, None, None]


def test_probe_dates(spark):
    outputs = ['{"format":{"tags":{"creation_time":"2023-04-15T10:00:00Z"}},"streams":[]}', '{"streams":[{"tags":{}},{"tags":{"creation_time":"2022-01-02T00:00:00Z"}}]}', "{}", "junk"]
    got = each(spark, outputs, dates.probe_date)
    assert [x and x.date() for x in got] == [datetime.date(2023, 4, 15), datetime.date(2022, 1, 2), None, None]


def test_seasons(spark):
    days = [datetime.date(2023, m, 1) for m in (1, 3, 6, 9, 12)]
    assert each(spark, [*days, None], dates.season, "date") == ["Winter", "Spring", "Summer", "Autumn", "Winter", None]


def test_sizes(spark):
    assert each(spark, [0, 1023, 1024, 1280, 1048575, 1048576, 2**60], values.fmt_size, "long") == ["0B", "1023B", "1.0KB", "1.2KB", "1024.0KB", "1.0MB", "1.0EB"]


def test_states(spark):
    df = spark.sql("SELECT * FROM VALUES (false, 3L, true), (true, null, null), (true, 0L, null), (true, 2L, false), (true, 2L, true) AS t(m, f, c)")
    assert [r.s for r in df.select(values.cell_state(F.col("m"), F.col("f"), F.col("c")).alias("s")).collect()] == ["unknown", "absent", "absent", "present", "checksummed"]
