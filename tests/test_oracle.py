"""Every query with SQL of its own against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries of the optional part are tested beside it.
from pipelens import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, (list, dict)):
            return repr(v)
        if v is None or v is pd.NA or v != v:
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.EXAMPLES))
def test_operators_on_fixed_rows(spark, duck, name):
    assert name not in entry.queries()
    got, want = registry.EXAMPLES[name](spark, SF).toPandas(), duck.execute(registry.EXAMPLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_label_propagation_is_that_of_turns(spark, duck):
    """Nodes in byte order, each seeing the labels of this round: the heaviest label around it, of equals the smallest."""
    parts = {f"{k:012}": (b, s, k) for k, b, s in duck.execute("SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey > 0").fetchall()}
    label, near = {n: b for n, (b, _, _) in parts.items()}, {n: [] for n in parts}
    for n, (_, size, k) in parts.items():
        up = f"{k // 2:012}"
        if k > 1 and up in parts:
            near[n].append((up, size))
            near[up].append((n, size))
    for _ in range(10):
        before = dict(label)
        for n in sorted(parts):
            votes: dict = {}
            for other, w in near[n]:
                votes[label[other]] = votes.get(label[other], 0) + w
            if votes:
                label[n] = min(votes, key=lambda x: (-votes[x], x))
        if label == before:
            break
    got = {r.node: r.label for r in entry.queries()["label_propagation_parts"](spark, SF).collect()}
    assert got == label and len(set(label.values())) > 3


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
