"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import cueloom.plans.bundle_queries  # noqa: F401
import cueloom.plans.insight_queries  # noqa: F401
import cueloom.plans.library_queries  # noqa: F401
import cueloom.plans.media_queries  # noqa: F401
import cueloom.plans.more_queries  # noqa: F401
import cueloom.plans.state_queries  # noqa: F401
from cueloom.plans.queries import QUERIES, SQL

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(repr, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toArrow().to_pandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_the_training_data_part():
    """The entry module imports and has the other queries where that part is absent."""
    import subprocess
    import sys

    code = "import sys; sys.modules['cueloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'queue_snapshot' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
