"""Every query with a DuckDB statement gives the statement's rows; every other one runs."""

import datetime as dt

import duckdb
import pytest

from tallyforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = duck.sql(registry.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_models_do_what_their_baselines_do_not(spark, small):
    q = registry.QUERIES
    assert q["kmeans_parity"](spark, small).first().agreement == 1.0
    assert q["lsh_recall"](spark, small).first().recall > 0.8
    assert q["run_quality_conservation"](spark, small).first().rejected > 0
    scores = {r.baseline: r.silhouette for r in q["kmeans_baselines"](spark, small).collect()}
    assert q["kmeans_sweep"](spark, small).where("k = 2").first().mean_silhouette > scores["permuted"]


def test_sweep_fits_on_a_table_that_is_not_cached(spark, small, monkeypatch):
    """On a cached table a fit would decode its rows anew in every iteration."""
    seen = []

    def sweep(rows, ks, seeds):
        seen.append((rows.columns, rows.storageLevel.useMemory, len(ks) * len(seeds)))
        return spark.createDataFrame([(2, 1, 1.0, 0.5, 3, 4)], "k int, seed int, inertia double, silhouette double, iterations int, least_size long")

    monkeypatch.setattr("tallyforge.operators.clusters.sweep", sweep)
    assert registry.QUERIES["kmeans_sweep"](spark, small).first().chosen
    assert seen == [(["item", "z"], False, 27)]


def test_visits_are_counted_for_every_product(spark, small):
    seen = registry.QUERIES["search_visits"](spark, small).first()
    assert seen.n_queries == registry.QUERIES["product_features"](spark, small).count() > 100
    assert seen.n_queries <= seen.visits <= seen.n_queries * seen.n_blocks


@pytest.mark.parametrize("name", ["nearest_vectors", "knn_votes", "knn_confusion", "knn_sweep", "label_agreement"])
def test_every_vector_is_a_query(spark, small, name):
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    out = registry.QUERIES[name](spark, small)
    if name == "nearest_vectors":
        assert out.count() == 20 * n
    elif name == "knn_votes":
        assert out.count() == n
    elif name == "knn_confusion":
        assert out.groupBy().sum("n_rows").first()[0] == n
    elif name == "knn_sweep":
        assert "vec_id %" not in registry.ORACLES[name] and out.count() == 4
    else:
        assert {r.queries for r in out.collect()} == {n}
