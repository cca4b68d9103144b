"""Running sums, thresholds, preflight, manifests, bundles, model artifacts and intermediate tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions import tables
from tallyforge.functions.numbering import running_sums
from tallyforge.operators import catalog, clusters, evaluate, registry, revenue
from tallyforge.sources import digests, readers, writers

HEAD = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
ROW = "2020-02-03 04:05:06 UTC,purchase,p7,{0},home.lamp,acme,3.20,u9,s4"


def test_running_sums_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 600), rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "k int, at int, v long").repartition(7)
    got = {(r.k, r["at"]): r.total for r in running_sums(df, ("k",), [F.desc("at")], {"v": "total"}).collect()}
    want = {(k, i): sum(x for kk, j, x in rows if kk == k and j >= i) for k, i, _ in rows}
    assert got == want
    whole = running_sums(df, (), ["at"], {"v": "total"})
    assert whole.columns == [*df.columns, "total"] and whole.agg(F.max("total")).first()[0] == sum(v for *_, v in rows)
    assert running_sums(df.limit(0), ("k",), ["at"], {"v": "total"}).count() == 0


def test_metrics_at_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40)]
    scored, cuts = spark.createDataFrame(rows, "label int, score double"), [0.0, 0.25, 0.26, 0.975, 2.0]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.at_thresholds(scored, spark.createDataFrame([(c,) for c in cuts], "threshold double")).collect()}
    count = lambda y, test: sum(a == y and test(s) for a, s in rows)
    assert got == {c: (count(1, lambda s: s >= c), count(0, lambda s: s >= c), count(1, lambda s: s < c), count(0, lambda s: s < c)) for c in cuts}


def test_weights_are_poisson_and_differences_are_paired(spark):
    rows = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 2).alias("label"), (F.col("id") % 3 == 0).cast("int").alias("prediction"))
    w = evaluate.weighted(rows, 200, 3).agg(F.sum("weight"), F.max("weight")).first()
    assert abs(w[0] / 80_000 - 1) < 0.02 and 5 <= w[1] <= 11
    same = evaluate.bootstrap_difference(rows.withColumn("other", F.col("prediction")), "other", 50)
    assert same.count() == 50 and same.where("difference <> 0").count() == 0
    scored = rows.withColumn("score", F.col("label").cast("double"))
    assert {r.average_precision for r in evaluate.bootstrap_average_precision(scored, 20).collect()} == {1.0}


def test_preflight_of_files_and_their_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.csv").write_text("\n".join([HEAD, ROW.format("12"), ROW.format("9" * 300), ROW.format("x")]) + "\n")
    (tmp_path / "in" / "late.csv").write_text("\n".join([ROW.format("12"), HEAD, "broken"]) + "\n")
    lines = readers.event_lines(spark, str(tmp_path / "in"))
    got = {r.file.rsplit("/", 1)[-1]: r for r in catalog.preflight(lines).collect()}
    good, late = got["good.csv"], got["late.csv"]
    assert (good.n_lines, good.headers, good.header_first, good.valid_purchases, good.malformed, good.invalid_groups, good.overlong_keys) == (4, 1, True, 1, 0, 1, 1)
    assert (late.header_first, late.headers, late.malformed) == (False, 1, 1)
    with pytest.raises(ValueError, match="named twice"):
        readers.event_lines(spark, str(tmp_path / "in"), str(tmp_path / "in" / "good.csv"))
    listed = catalog.input_manifest(spark, str(tmp_path / "in"))
    before = catalog.manifest_fingerprint(listed).first()
    assert before.n_files == 2 and catalog.manifest_fingerprint(listed.repartition(3)).first() == before
    (tmp_path / "in" / "late.csv").write_text("other\n")
    assert catalog.manifest_fingerprint(catalog.input_manifest(spark, str(tmp_path / "in"))).first().fingerprint != before.fingerprint
    assert catalog.policy_hash("category_id") == catalog.policy_hash("category_id") != catalog.policy_hash("category_root")
    in_ranges = digests.manifest_digest(listed, range_files=1).first()
    assert in_ranges.n_files == 2 and in_ranges.fingerprint != before.fingerprint


def test_dictionary_guard(spark):
    words = catalog.dictionary(spark.createDataFrame([("b",), ("a",)], "group_key string"))
    assert catalog.dictionary_checksum(words).first().n_keys == 2
    with pytest.raises(ValueError, match="more than 1 keys"):
        catalog.dictionary_checksum(words, max_keys=1)


def test_model_artifacts_and_replay(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)], i % 2) for i in range(60)], "row long, features array<double>, label int").withColumn("id", F.col("row"))
    from pyspark.ml.clustering import KMeansModel
    from pyspark.ml.functions import array_to_vector

    model = clusters.fit(rows.select(array_to_vector("features").alias("z")), 2, 1)
    path = writers.write_model(spark, str(tmp_path), "m1", "kmeans", {"kmeans": model}, {"centers": clusters.centers(model, spark), "train": rows}, k=2)
    record = json.loads(spark.read.text(f"{path}/record").first().value)
    assert record["model_type"] == "kmeans" and record["tables"] == ["centers", "train"] and record["k"] == 2
    assert np.allclose(KMeansModel.load(f"{path}/model_kmeans").clusterCenters(), model.clusterCenters())
    with pytest.raises(FileExistsError):
        writers.write_model(spark, str(tmp_path), "m1", "kmeans", {}, {})
    saved = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, vote_share double")
    near = saved.withColumn("vote_share", F.col("vote_share") + 1e-14)
    assert registry.replay(saved, near, "id", ("vote_share",)).count() == 0
    assert registry.replay(saved, near.withColumn("vote_share", F.col("vote_share") + 1e-9), "id", ("vote_share",)).count() == 2


def test_raw_counts_scored_by_neighbours(spark):
    train = spark.createDataFrame([(i, f"t{i}", [float(i)], int(i < 5)) for i in range(10)], "row long, id string, features array<double>, label int")
    raw = spark.createDataFrame([("few", 1, 0, 0, 1, 1.0, 1), ("many", 9000, 9, 1, 5, 2.0, 9), ("none", 0, 0, 0, 0, 1.0, 0)], "product_id string, views long, carts long, purchases long, recent_views long, median_price double, distinct_users long")
    got = {r.product_id: r for r in registry.score_raw_neighbours(raw, {"log_views": (0.0, 1.0)}, train, 3, 0.5, 2).collect()}
    assert (got["few"].vote_share, got["few"].prediction, got["few"].warnings) == (1.0, 1, ["views_below_minimum"])
    assert (got["many"].vote_share, got["many"].prediction, got["many"].out_of_domain) == (0.0, 0, False)
    assert got["none"].vote_share is None and got["none"].out_of_domain


def test_final_train_set_and_portable_parts(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    for portable in (True, False):
        parts = catalog.fit_validation(rows, "k", 3, portable=portable)
        final = catalog.final_train_set(parts, "k").collect()
        assert sorted(r.row for r in final) == list(range(400)) and [r.k for r in sorted(final, key=lambda r: r.row)] == sorted(r.k for r in final)
        assert 40 < sum(r.part == "validation" for r in final) < 130


def test_exports_show_amounts(spark, tmp_path):
    writers.export_csv(spark.createDataFrame([("b", 5), ("a", 1234)], "k string, revenue_minor long"), str(tmp_path / "out"), "k", money=("revenue_minor",))
    assert next((tmp_path / "out").glob("part-*")).read_text() == "k,revenue_minor,revenue\na,1234,12.34\nb,5,0.05\n"


def test_intermediate_tables_are_removed(spark):
    kept, gone = tables.durable(spark.range(5)), tables.durable(spark.range(7))
    paths = [f"{tables.shared_folder(spark)}/{p.split('/')[-2]}" for p in (kept.inputFiles()[0], gone.inputFiles()[0])]
    tables.forget(gone)
    assert [tables.path_exists(spark, p) for p in paths] == [True, False] and kept.count() == 5
    empty = tables.durable(spark.range(5).where("id > 9"))
    assert empty.count() == 0 and empty.columns == ["id"]


def test_revenue_of_lines_without_any_purchase(spark):
    assert revenue.revenue_from_lines(spark.createDataFrame([(HEAD,), ("",)], "value string")).count() == 0


def test_each_digest_is_made_once_and_every_replicate_counts(spark):
    rows = spark.createDataFrame([("a/1", 1, 1, 0.5), ("b/2", 0, 0, 0.25), ("c/3", 0, 1, 0.25)], "i string, label int, prediction int, score double")
    found = evaluate.bootstrap_f1(rows, 200, 7)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert found.count() == 200 and evaluate.bootstrap_f1(rows.where("i = 'b/2'"), 200, 7).where("f1 = 0").count() == 200


def test_weights_in_python_and_by_columns_are_the_poisson_numbers_of_the_digest(spark):
    rows = spark.createDataFrame([("a/1",), ("",), (None,), ("é",)], "i string")
    own = evaluate._weights(["a/1", "", None, "é"], 300, 7)
    plain = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(299)))).withColumn("w", S.poisson_one(S.digest_uniform(F.lit(7), "b", "i")))
    for table, w in ((plain, "w"), (evaluate.weighted(rows, 300, 7), "weight")):
        got = {(r.i, r.b): r[w] for r in table.collect()}
        assert [[got[i, b] for b in range(300)] for i in ("a/1", "", None, "é")] == own.astype(int).tolist()
