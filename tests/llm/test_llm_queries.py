"""The queries of this part that have SQL, against it, and the rest on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT / "tools"))
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
from graphloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    import duckdb
    from compare import rows

    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = queries.QUERIES[name](spark, FOLDER)
    c, got = rows(df.columns, df.collect())
    cur = con.execute(queries.SQL[name])
    d, want = rows([x[0] for x in cur.description], cur.fetchall())
    assert c == d and got == want


def test_neighbours_against_brute_force(spark):
    import numpy as np

    v = queries.current_vectors(spark, FOLDER).toPandas().sort_values("rec_id")
    ids = v["rec_id"].to_numpy()
    x = np.stack(v["emb"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    want = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, row in enumerate(top) for j in row if s[i, j] > 0.85}
    got = {tuple(r) for r in queries.p3_found(spark, FOLDER).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("name", ["p6_ids", "p7_found", "p8_report"])
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(df.columns) >= 2
