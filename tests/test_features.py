import random

import duckdb
import pytest

from tidewell.plans import more_queries, panel_queries

WIDTH = 20
QUERIES = {**panel_queries.QUERIES, **more_queries.QUERIES}
SQL = {**panel_queries.SQL, **more_queries.SQL}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of WIDTH elements, of which the last one follows the label most."""
    rng, path = random.Random(3), tmp_path_factory.mktemp("features")
    labels = [i % 4 for i in range(60)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(WIDTH - 1)] + [y + rng.gauss(0, 0.1)], y) for i, y in enumerate(labels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["fe_assoc", "fe_fold_select", "fe_bh", "fe_vote", "fe_univariate_spearman", "fe_consensus", "lim_feature"])
def test_every_element_is_a_feature(spark, folder, name):
    got = QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    rows = db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]}) ORDER BY feature").fetchall()
    found = [tuple(r) for r in got.orderBy("feature").collect()]
    assert [r[0] for r in found] == [r[0] for r in rows] and WIDTH in [r[0] for r in found]
    assert all(a == pytest.approx(b, abs=2e-6) for f, r in zip(found, rows) for a, b in zip(f, r))
