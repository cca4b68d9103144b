from collections import defaultdict

import duckdb
import pytest

from tallyforge.llm import linededup
from tallyforge.llm.queries import OP7_SQL, op7_line_dedup

SCHEMA = "doc_id long, text string, source string, line string, site int"


def brute(rows, ratio):
    """Pages with a line over pages of the host, page by page."""
    pages, lines = defaultdict(int), defaultdict(int)
    for _, text, host, *_ in rows:
        if host is not None:
            pages[host] += 1
            for x in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
                lines[host, x] += 1
    bad = {k for k, n in lines.items() if n > 1 and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in bad), h) for i, t, h, *_ in rows]


def rows():
    out = [(i, f"menu\nbody {i}\n\n menu\t\r\nfoot" + ("\nrare" if i % 9 == 0 else ""), "a", "l", 1) for i in range(40)]
    out += [(100 + i, "same page\nmenu", "b", "l", 1) for i in range(30)] + [(200, "menu", "c", "l", 1)]
    out += [(300, None, "a", "l", 1), (301, "", "a", "l", 1), (302, "menu", None, "l", 1), (None, "menu\nx", "a", "l", 1), (303, "menu\n" * 20_000 + "z", "a", "l", 1)]
    return out + out[:3]


@pytest.mark.parametrize("few", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", few)
    df = spark.createDataFrame(rows(), SCHEMA)
    out = linededup.drop_boilerplate(df, ratio=0.2)
    assert out.columns == [*df.columns, "dropped_lines"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=key) == sorted(brute(rows(), 0.2), key=key)


def dropped(spark, texts, **how):
    df = spark.createDataFrame([(k, t, "host", "c", 1) for k, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.dropped_lines for r in linededup.drop_boilerplate(df, **how).collect()}


def test_small_hosts_and_copies_count_by_the_ratio_alone(spark):
    assert dropped(spark, [f"menu\nbody {k}" for k in range(4)]) == dict.fromkeys(range(4), 1)
    assert set(dropped(spark, ["menu\nx"] * 50 + [f"menu {k}" for k in range(20)], ratio=0.5).values()) == {0, 2}
    assert dropped(spark, ["menu\nalone"]) == {0: 0}
    assert dropped(spark, ["menu", "menu", "x", "y"], ratio=0.5) == dict.fromkeys(range(4), 0)


def test_a_column_of_the_result_s_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "menu\na", "h", 9), (2, "menu\nb", "h", 9)], "doc_id long, text string, source string, dropped_lines int")
    out = linededup.drop_boilerplate(df)
    assert out.columns == df.columns and {r.dropped_lines for r in out.collect()} == {1}


def test_empty(spark):
    assert linededup.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_duckdb(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted((r.doc_id, r.source, r.dropped_lines, r.kept_chars, r.kept_md5) for r in op7_line_dedup(spark, small).collect())
    assert got == sorted(duckdb.sql(OP7_SQL).fetchall()) and sum(r[2] for r in got) > 0
