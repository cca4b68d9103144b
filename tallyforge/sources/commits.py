"""Runs that appear whole or not at all: a claim, a staged folder, one rename, and a pointer to the newest run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tallyforge.functions.tables import path_exists, remove

#: Versions of the pointer that stay when a newer one is written.
KEPT_VERSIONS = 10


def run_path(root: str, run_id: str) -> str:
    return f"{root}/run_id={run_id}"


def _there(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist; False if it does, which the file system decides for one of several writers."""
    files, where = _there(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    files, where = _there(spark, f"{root}/_pointer")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()) if files.exists(where) else []


def pointed(spark: SparkSession, root: str) -> str | None:
    """The newest run that was committed below `root`, from the last version of its pointer: one small file, no listing of runs."""
    while versions := _versions(spark, root):
        try:
            return json.loads(spark.read.text(f"{root}/_pointer/{versions[-1]:012d}").first().value)["run_id"]
        except Exception:
            if versions[-1] in _versions(spark, root):  # else a writer has replaced it meanwhile
                raise
    return None


def _point(spark: SparkSession, root: str, run_id: str) -> None:
    """Add a version of the pointer: of the run it names and this one, the newer. Who finds the version taken reads again."""
    while True:
        versions = _versions(spark, root)
        newest = max(run_id, pointed(spark, root) or run_id)
        if create(spark, f"{root}/_pointer/{(versions or [0])[-1] + 1:012d}", json.dumps({"run_id": newest})):
            for old in versions[: 1 - KEPT_VERSIONS]:
                remove(spark, f"{root}/_pointer/{old:012d}")
            return


@contextmanager
def new_run(spark: SparkSession, root: str, run_id: str) -> Iterator[str]:
    """Gives the folder to write a run into; when the block ends well, it becomes the run, and the pointer moves.

    A second writer of a run id fails before any work, also while the first is still writing. If the block fails, what it
    wrote and its claim are removed, so that the run can be written again. The name of a claim whose writer was lost
    stands in `_claims` until `give_up` removes it.
    """
    if path_exists(spark, run_path(root, run_id)) or not create(spark, f"{root}/_claims/{run_id}", "{}"):
        raise FileExistsError(f"run {run_id} already exists below {root}, or is being written")
    staged = f"{root}/_staging/{run_id}-{uuid.uuid4().hex}"
    try:
        yield staged
        files, final = _there(spark, run_path(root, run_id))
        if files.exists(final) or not files.rename(_there(spark, staged)[1], final):
            raise FileExistsError(f"run {run_id} could not be put below {root}")
    except BaseException:
        remove(spark, staged)
        give_up(spark, root, run_id)
        raise
    _point(spark, root, run_id)


def give_up(spark: SparkSession, root: str, run_id: str) -> None:
    """Remove the claim of a run whose writer is gone."""
    remove(spark, f"{root}/_claims/{run_id}")
