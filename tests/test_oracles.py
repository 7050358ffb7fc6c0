"""Every registered query against its DuckDB oracle (sf0.001), as the driver checks at sf0.01."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.compare import compare

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(results, name):
    r = results[name]
    assert "error" not in r, r.get("error")
    if name in entry.oracle_sql():
        assert r["cols_ok"], r
        assert r["rows"] == r["oracle_rows"], r
        assert r["match"], r
    else:
        assert r["rows"] >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["question_id", "domain", "rank", "chunk_pos", "page", "content", "score", "distance"]
