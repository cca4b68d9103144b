"""Files, bundles, neighbours, clusters and records."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered
from tallyforge.operators import clusters, evaluate, neighbours, pages, registry
from tallyforge.sources import readers, writers


def test_event_lines_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"x,1\r\ny,2\n")
    (tmp_path / "in" / "b.txt").write_text("no")
    got = readers.event_lines(spark, str(tmp_path / "in"))
    assert sorted(r.value for r in got.collect()) == ["x,1\r", "y,2"]
    with pytest.raises(ValueError):
        readers.event_lines(spark, str(tmp_path / "in"), str(tmp_path / "in"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.event_lines(spark, str(tmp_path / "empty"))
    (tmp_path / "r.tsv").write_text("1\t60.00\t3\t20.00\n1\t0.03\t3\t0.01\n")
    rows = readers.result_rows(spark, str(tmp_path / "r.tsv"))
    assert rows.agg(F.sum("sum_minor")).first()[0] == 6003 and readers.repeated_groups(rows).count() == 1
    (tmp_path / "bad.tsv").write_text("1\t60.00\t3\t19.99\n")
    with pytest.raises(Exception, match="result row is wrong"):
        readers.result_rows(spark, str(tmp_path / "bad.tsv")).collect()


def test_publish_and_verify(spark, tmp_path):
    root = str(tmp_path / "runs")
    table = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, t string")
    path = writers.publish(spark, root, "2", {"one": table, "two": table.limit(1)})
    listed = spark.read.parquet(f"{path}/_manifest_table")
    assert {(r.name, r.rows) for r in listed.where("rows is not null").collect()} == {("one", 2), ("two", 1)}
    assert readers.verified_files(spark, path, listed).where("not matches").count() == 0
    assert readers.verified_files(spark, path, listed.withColumn("sha256", F.lit("0"))).where("matches").count() == 0
    with pytest.raises(FileExistsError):
        writers.publish(spark, root, "2", {"one": table})
    writers.write_small(table, str(tmp_path / "flat"), "1")
    writers.write_small(table, str(tmp_path / "flat"), "2")
    assert readers.latest_run(spark, str(tmp_path / "flat")) == "2"
    assert readers.run_table(spark, str(tmp_path / "flat"), "1", ("k",)).count() == 2
    with pytest.raises(ValueError):
        readers.run_table(spark, str(tmp_path / "flat"), "1", ("missing",))
    writers.export_csv(table, str(tmp_path / "csv"), "k")
    assert next((tmp_path / "csv").glob("part-*")).read_text() == "k,n,t\na,1,\nb,2,x\n"
    writers.write_record(spark, str(tmp_path / "record"), status="ok", rows=2)
    assert spark.read.json(str(tmp_path / "record")).first().status == "ok"
    labels = spark.createDataFrame([("p", "train"), ("q", "test")], "product_id string, split string")
    assert spark.read.parquet(writers.write_labels(labels, str(tmp_path / "labels"), "1")).where("split = 'test'").count() == 1


def points(spark, rows):
    return spark.createDataFrame([(i, i, [float(x) for x in p]) for i, p in enumerate(rows)], "row long, id long, features array<double>")


def test_votes_of_neighbours(spark):
    six = points(spark, [[1.0]] * 6)
    found = neighbours.exact(six, spark.createDataFrame([(9, [1.0])], "query_id long, features array<double>"), 3)
    assert [r.neighbour_row for r in found.orderBy("place").collect()] == [0, 1, 2]
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(6)], "neighbour_row long, label int")
    vote = neighbours.vote_share(found, labels, 3, 0.6).first()
    assert abs(vote.vote_share - 2 / 3) < 1e-12 and vote.prediction == 1
    itself = neighbours.exact(six, six.select(F.col("id").alias("query_id"), "features"), 2, exclude_self=True)
    assert itself.where("query_id = neighbour_id").count() == 0 and itself.count() == 12


def test_assignment_ties_scaling_and_price_groups(spark):
    centers = spark.createDataFrame([(1, [2.0]), (0, [0.0])], "cluster int, center array<double>")
    rows = points(spark, [[1.0], [1.5]])
    assert [r.cluster for r in clusters.assign(rows, centers, "id").orderBy("id").collect()] == [0, 1]
    assert spark.range(1).select(S.standardized(F.lit(3.0), 1.0, 0.0), S.standardized(F.lit(3.0), 1.0, 4.0)).first()[:] == (0.0, 0.5)
    priced = spark.createDataFrame([(i, float(i % 5)) for i in range(11)], "id long, price double")
    sizes = {r.cluster: r["count"] for r in clusters.price_groups(priced, 3, "price", "id").groupBy("cluster").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 3}


def test_numbering_and_permutation(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 10).alias("x"))
    got = numbered(rows.repartition(6), F.desc("id")).collect()
    assert all(r.row == 999 - r.id for r in got)
    mixed = clusters.permuted(rows, ("id", "x"), "id", 3)
    assert mixed.count() == 1000 and mixed.agg(F.sum("x"), F.sum("id")).first() == rows.agg(F.sum("x"), F.sum("id")).first()
    assert numbered(rows.limit(0), "id").count() == 0


def test_names_registry_pages_and_scores(spark):
    two = spark.createDataFrame([(0, 5.0, 0.1), (1, 9.0, 0.4)], "cluster int, mean_views double, purchase_share double")
    assert {r.cluster: r.name for r in clusters.named(two).collect()} == {0: "normal", 1: "hot"}
    unsure = spark.createDataFrame([(0, 5.0, 0.9), (1, 9.0, 0.4)], two.schema)
    assert {r.name for r in clusters.named(unsure).collect()} == {None}
    records = spark.createDataFrame([("knn", "m1", "s1"), ("knn", "m1", "s2"), ("knn", "m2", "s2"), ("kmeans", "m3", "s1")], "model_type string, model_run string, serving_run string")
    assert sorted((r.model_run, r.serving_run) for r in registry.latest(records, "knn").collect()) == [("m1", "s2"), ("m2", "s2")]
    assert registry.find(records, "knn").first().model_run == "m2" and registry.find(records, "knn", "m1").first().serving_run == "s2"
    table = spark.createDataFrame([("9",), ("10",), (None,), ("x",)], "v string")
    assert [r.v for r in pages.page(table, "v", limit=4).collect()][-2:] == ["9", "10"]
    assert pages.page_total(table, "X").first().total == 1
    with pytest.raises(ValueError):
        pages.page(table, "v", limit=9000)
    raw = spark.createDataFrame([("p", 1, 3, 5, 2, 1.0, 1)], "product_id string, views long, carts long, purchases long, recent_views long, median_price double, distinct_users long")
    parameters = {"log_views": (0.0, 1.0)}
    scored = registry.score_raw(raw, parameters, spark.createDataFrame([(0, [0.0])], "cluster int, center array<double>"), 2).first()
    assert scored.out_of_domain and set(scored.warnings) == {"views_below_minimum", "carts_above_views", "purchases_above_views", "recent_above_views"}


def test_average_precision_with_ties_and_undefined_rates(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert abs(evaluate.average_precision(rows).first()[0] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert evaluate.best_threshold(rows).first().threshold == 0.5
    none = spark.createDataFrame([(0, 0)], "label int, prediction int")
    m = evaluate.binary_metrics(none).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    means = evaluate.bootstrap_mean(spark.createDataFrame([(i, float(i)) for i in range(20)], "i long, value double"), 200)
    low, high = evaluate.interval(means, "mean").first()
    assert low < 9.5 < high and means.count() == 200


def test_permuted_columns_meet_without_a_join(spark):
    rows = spark.createDataFrame([(i, float(i) if i else None, i % 5) for i in range(60)], "id long, x double, y long")
    mixed = clusters.permuted(rows, ("x", "y"), "id", 3)
    assert mixed.schema["x"].dataType == rows.schema["x"].dataType and mixed.schema["y"].dataType == rows.schema["y"].dataType
    got = mixed.collect()
    assert all(sorted(map(str, (r[c] for r in got))) == sorted(map(str, (r[c] for r in rows.collect()))) for c in ("x", "y")) and [r.row for r in sorted(got)] == list(range(60))
    # what is left joins the starts of the partitions to each column, one row a partition
    assert mixed._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_codes_beside_revenue_and_products_beside_events_are_not_broadcast(spark, small):
    from tallyforge.operators import metrics, revenue
    from tallyforge.plans.behaviour import curated

    events = curated(spark, small, merge=True)
    joined = revenue.with_codes(revenue.revenue(events), metrics.funnel_by_category(events))
    assert joined.count() == revenue.revenue(curated(spark, small)).count()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert events.count() == curated(spark, small).count()


def test_published_models_broadcast_no_table_of_products_or_labels(spark, small):
    from tallyforge.operators import neighbours
    from tallyforge.plans.behaviour import curated
    from tallyforge.plans.learning import labels
    from tallyforge.plans.registry import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(labels(spark, small, curated(spark, small, merge=True)))
    near = spark.createDataFrame([("q", 1, 1)], "query_id string, neighbour_row long, place int")
    assert "Broadcast" not in plan(neighbours.vote_share(near, spark.createDataFrame([(1, 1)], "neighbour_row long, label int"), 3))

    store = spark._jsparkSession.sharedState().statusStore()
    seen = lambda: [(e.executionId(), e.physicalPlanDescription()) for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))]
    last = max((i for i, _ in seen()), default=-1)
    assert QUERIES["kmeans_replay"](spark, small).first().differing == 0
    assert QUERIES["published_models"](spark, small).count() == 8
    plans = [p for i, p in seen() if i > last]
    joins = [block.split("\n")[1] for p in plans for block in p.split("\n\n") if "BroadcastHashJoin" in block.split("\n")[0] and block.startswith("(")]
    assert len(plans) > 20 and all("_part#" in keys for keys in joins), joins  # only the starts of partitions are broadcast
