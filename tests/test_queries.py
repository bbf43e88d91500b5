import pytest
from compare import both

import fixity_spark.queries_io  # noqa: F401 (registers more)
import fixity_spark.queries_sets  # noqa: F401 (registers more)
from fixity_spark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs = both(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name, by", [("check_summary", ["year", "slug"]), ("arrivals_by_day", ["day"]), ("years_present", ["-year"]), ("unresolved_requests", ["year", "num"]), ("season_groups", ["location", "year", "season"])])
def test_reports_come_in_order(spark, sf_dir, name, by):
    """Rows are compared as they come."""
    got = [tuple(-r[c[1:]] if c[0] == "-" else r[c] for c in by) for r in QUERIES[name](spark, sf_dir).collect()]
    assert got == sorted(got) and len(got) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_text_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['fixity_spark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'check_summary' in q and not any(n.startswith('op') for n in q), list(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
