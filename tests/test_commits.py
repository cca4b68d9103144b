"""Runs that appear whole, their pointer, digests of files of any size, and bundles with models."""

import hashlib
import json
import threading

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyforge.operators import catalog
from tallyforge.sources import commits, digests, readers, writers


def test_a_second_writer_fails_before_work_and_while_the_first_writes(spark, tmp_path):
    root, table = str(tmp_path / "runs"), spark.range(3)
    with commits.new_run(spark, root, "7") as staged:
        table.write.parquet(staged)
        assert not (tmp_path / "runs" / "run_id=7").exists()
        with pytest.raises(FileExistsError):
            writers.write_small(table, root, "7")
    assert readers.run_table(spark, root, "7").count() == 3
    with pytest.raises(FileExistsError):
        writers.write_small(table, root, "7")
    assert readers.run_table(spark, root, "7").count() == 3 and not list((tmp_path / "runs" / "_staging").glob("*"))


def test_a_failed_writer_leaves_nothing_and_may_try_again(spark, tmp_path):
    root = str(tmp_path / "runs")
    with pytest.raises(ZeroDivisionError), commits.new_run(spark, root, "1") as staged:
        spark.range(3).write.parquet(staged)
        raise ZeroDivisionError
    assert not list((tmp_path / "runs").glob("run_id=*")) and commits.pointed(spark, root) is None
    writers.write_small(spark.range(4), root, "1")
    assert commits.pointed(spark, root) == "1"


def test_the_pointer_names_the_newest_run_whatever_the_order(spark, tmp_path):
    root = str(tmp_path / "runs")
    for run in ("3", "9", "5"):
        writers.write_small(spark.range(1), root, run)
        assert readers.latest_run(spark, root) == max(x for x in ("3", "9", "5") if (tmp_path / "runs" / f"run_id={x}").exists())
    for n in range(15):
        commits._point(spark, root, f"9{n:02d}")
    assert commits.pointed(spark, root) == "914" and len(list((tmp_path / "runs" / "_pointer").glob("0*"))) <= commits.KEPT_VERSIONS + 1
    assert sorted(r.run_id for r in readers.runs(spark, root).collect()) == ["3", "5", "9"]


def test_of_many_writers_of_one_run_one_wins(spark, tmp_path):
    root, ended = str(tmp_path / "runs"), []

    def write(k):
        try:
            writers.write_small(spark.range(k), root, "1")
            ended.append(k)
        except FileExistsError:
            ended.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for k in ended if k]
    assert len(ended) == 4 and len(won) == 1 and readers.run_table(spark, root, "1").count() == won[0]


def test_digests_of_hidden_empty_and_large_files(spark, tmp_path):
    files = {"a.txt": b"alpha", "deep/b.bin": bytes(range(256)) * 50, "_SUCCESS": b"", "deep/.c": b"hidden", "_d/e": b"below hidden"}
    for name, content in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    want = {(name, len(content), hashlib.sha256(content).hexdigest()) for name, content in files.items()}
    for limit in (1 << 30, 1000, 0):
        got = {(r.path.split("/in/")[1], r.bytes, r.sha256) for r in digests.file_digests(spark, str(tmp_path / "in"), whole_bytes=limit).collect()}
        assert got == want
    assert {r.uri.split("/in/")[1] for r in catalog.input_manifest(spark, str(tmp_path / "in")).collect()} == {"a.txt", "deep/b.bin", "_d/e"}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    (tmp_path / "big").mkdir()
    with open(tmp_path / "big" / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    row = digests.file_digests(spark, str(tmp_path / "big")).first()
    whole = hashlib.sha256()
    for _ in range(3 << 6):
        whole.update(bytes(1 << 24))
    assert (row.bytes, row.sha256) == (3 << 30, whole.hexdigest())


def test_a_manifest_of_many_files(spark):
    rows = spark.range(150_000).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("uri"), F.col("id").alias("bytes"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    lines = [f"f{i:07d}\t{i}\t{hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(150_000)]
    ranges = [hashlib.sha256("\n".join(lines[at : at + digests.RANGE_FILES]).encode()).hexdigest() for at in range(0, len(lines), digests.RANGE_FILES)]
    want = (150_000, sum(range(150_000)), hashlib.sha256("\n".join(ranges).encode()).hexdigest())
    assert tuple(catalog.manifest_fingerprint(rows.repartition(5)).first()) == want
    assert catalog.manifest_fingerprint(rows.where("id <> 77")).first().fingerprint != want[2]
    assert tuple(catalog.manifest_fingerprint(rows.limit(0)).first()) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_a_bundle_holds_models_predictions_and_every_file(spark, tmp_path):
    train = spark.createDataFrame([(1, "b", 0, [2.0]), (0, "a,\"x\"", 1, [1.0])], "row long, item string, label int, center array<double>")
    predictions = spark.createDataFrame([("q1", 0.5, 1), ("q2", 0.0, 0)], "query_id string, vote_share double, prediction int")
    labels = spark.createDataFrame([("q1", 1), ("q2", 0), ("q3", 0)], "item string, label int")
    run = writers.write_model(spark, str(tmp_path / "models"), "m1", "knn", {"vectors": VectorAssembler(inputCols=["x"], outputCol="v")}, {"train_set": train, "predictions": predictions}, k=5)
    path = writers.publish(spark, str(tmp_path / "serving"), "s1", {"one": spark.range(3)}, {"knn": run}, labels)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/ml/knn/train_set").collect()
    assert [(r.row, r.item, r.center) for r in back] == [("0", 'a,"x"', "[1.0]"), ("1", "b", "[2.0]")]
    shown = spark.read.option("header", True).csv(f"{path}/ml/knn/products").collect()
    assert [(r.item, r.vote_share, r.label) for r in shown] == [("q1", "0.5", "1"), ("q2", "0.0", "0")]
    assert VectorAssembler.load(f"{path}/ml/knn/model_vectors").getOutputCol() == "v"
    assert [m["model_run"] for m in json.loads((tmp_path / "serving" / "run_id=s1" / "ml" / "models.json").read_text())] == ["m1"]
    listed = spark.read.parquet(f"{path}/_manifest_table")
    names = {p.relative_to(tmp_path / "serving" / "run_id=s1").as_posix() for p in (tmp_path / "serving" / "run_id=s1").rglob("*") if p.is_file()}
    assert {r.path for r in listed.collect()} == {n for n in names if not n.startswith("_manifest_table") and not n.endswith(".crc")}
    assert {(r.name, r.rows) for r in listed.where("rows is not null").collect()} == {("one", 3), ("ml/knn/train_set", 2), ("ml/knn/predictions", 2), ("ml/knn/products", 2)}
    assert readers.verified_files(spark, path, listed).where("not matches").count() == 0
    (tmp_path / "serving" / "run_id=s1" / "ml" / "models.json").write_text("[]")
    (tmp_path / "serving" / "run_id=s1" / "ml" / ".models.json.crc").unlink(missing_ok=True)
    assert [r.path for r in readers.verified_files(spark, path, listed).where("not matches").collect()] == ["ml/models.json"]
