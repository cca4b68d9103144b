"""Line numbers, byte offsets, sampling by offset and first errors, against a plain scan of the bytes."""

import glob
import hashlib
import random
from pathlib import Path

import pytest

from tallyforge.operators import classify
from tallyforge.sources import lines as physical

GOOD = "2020-02-03 04:05:06 UTC,purchase,p7,12,home.lamp,{},3.20,u9,s4"


def folder(tmp_path, seed=3):
    """Files with and without a mark, a header, a last line break; with CRs, empty lines and letters of several bytes."""
    rnd = random.Random(seed)
    (tmp_path / "in").mkdir()

    def body(n):
        return [rnd.choice([GOOD.format("acme"), GOOD.format("größe" * rnd.randint(0, 9)), GOOD.format("日本") + "\r", "broken", "", GOOD.format("x" * 300), GOOD.format("a").replace(",12,", "," + "9" * 300 + ",")]) for _ in range(n)]

    head = [classify.HEADER]
    files = {
        "a.csv": ("﻿" + "\n".join(head + body(700)) + "\n"), "b.csv": "\n".join(head + body(300)), "c.csv": "\n".join(body(50)) + "\n", "d.csv": "", "e.csv": "﻿" + classify.HEADER,
        "sub/a.csv": "\n".join(head + body(1500)) + "\n",
    }
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text.encode())
    return str(tmp_path / "in")


def scan(root):
    """(file, line, offset, bytes of the line) from front to back."""
    import pathlib

    out = []
    for path in sorted(pathlib.Path(root).rglob("*.csv")):
        data, at, n = path.read_bytes(), 0, 0
        while at < len(data):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            n += 1
            out.append((f"file:{path}", n, at, data[at:end].removeprefix(b"\xef\xbb\xbf") if at == 0 else data[at:end]))
            at = end + 1
    return out


@pytest.fixture(params=[None, "700", "64k"])
def split(spark, request):
    """How large the blocks of a file are."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_offsets_sample_and_errors_equal_a_scan(spark, tmp_path, split):
    root = folder(tmp_path)
    want = scan(root)
    located = physical.located_lines(spark, root)
    assert sorted((r.file, r.line, r.offset, r.value.encode()) for r in located.collect()) == want
    for rate, seed in ((0.2, 21), (1.0, -4)):
        drawn = []
        for file, line, offset, text in want:
            head = hashlib.sha256(file.encode() + b"\0" + seed.to_bytes(8, "big", signed=True) + offset.to_bytes(8, "big")).digest()[:4]
            if text.decode() != classify.HEADER and int.from_bytes(head, "big", signed=True) % 1_000_000 < rate * 1_000_000:
                drawn.append((file, line, offset, text))
        assert sorted((r.file, r.line, r.offset, r.value.encode()) for r in physical.sample_lines(located, rate, seed).collect()) == drawn
    wrong = []
    for file, line, offset, text in want:
        if line == 1 and text.decode() != classify.HEADER:
            wrong.append((file, line, offset, "MISSING_HEADER"))
        if text in (b"broken", b""):
            wrong.append((file, line, offset, "MALFORMED_CSV"))
        if b"9" * 300 in text:
            wrong.append((file, line, offset, "OVERLONG_KEY"))
    for n in (20, 2000):
        got = sorted((r.file, r.line, r.offset, r.error) for r in physical.first_errors(physical.physical_lines(spark, root), n=n).collect())
        assert len(got) == min(n, len(wrong)) and got == sorted(sorted(wrong)[:n])


def test_refusals(spark, tmp_path):
    root = folder(tmp_path)
    with pytest.raises(ValueError):
        physical.sample_lines(physical.located_lines(spark, root), 0, 1)
    with pytest.raises(ValueError):
        physical.physical_lines(spark, root, root)
    with pytest.raises(FileNotFoundError):
        physical.physical_lines(spark, root, glob="*.txt")


def test_lines_are_written_in_order_by_a_task_a_file(spark, small):
    from tallyforge.plans import behaviour, files

    folders = files._written(spark, small)
    written = [[x for p in sorted(glob.glob(f"{f.removeprefix('file:')}/part-*")) for x in Path(p).read_text(encoding="utf-8", newline="").split("\n")[:-1]] for f in folders]
    assert [len(glob.glob(f"{f.removeprefix('file:')}/part-*")) for f in folders] == [1, 1, 1]
    tasks = {Path(p).name.split("-")[1] for f in folders for p in glob.glob(f"{f.removeprefix('file:')}/part-*")}
    assert len(tasks) == 3
    rows = behaviour.lines(spark, small).orderBy("file", "event_id").collect()
    assert written == [[r.value for r in rows if r.file == f"f{k}"] for k in range(3)]
