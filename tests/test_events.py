"""Lines, revenue, metrics, quality, features and labels on small inputs worked out by hand."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import catalog, classify, compare, features, metrics, quality, revenue
from tallyforge.sources import readers

#: A small shop over two days: what each expected number below is counted from.
SHOP = """
2020-01-05 08:10:00|view|lamp1|501|light.floor|orbi|19.90|ann
2020-01-05 08:12:00|view|lamp1|501|light.floor|orbi|19.90|bob
2020-01-05 08:15:00|cart|lamp1|501|light.floor|orbi|19.90|ann
2020-01-05 08:20:00|purchase|lamp1|501|light.floor|orbi|19.90|ann
2020-01-05 09:00:00|view|lamp2|501|light.floor||5.05|cat
2020-01-05 09:01:00|purchase|lamp2|501|light.floor||5.05|cat
2020-01-06 09:30:00|cart|rug1|630|textile.rug|weft|120|bob
2020-01-06 09:31:00|remove_from_cart|rug1|630|textile.rug|weft|120|bob
2020-01-06 09:45:00|purchase|rug1|630|textile.rug|weft|120.00|bob
2020-01-06 09:50:00|purchase|tape|702|||1.25|bob
2020-01-06 09:55:00|view|tape|702|||1.25|dan
"""


def shop():
    fields = [x.split("|") for x in SHOP.strip().splitlines()]
    return [classify.HEADER] + [f"{time} UTC,{kind},{product},{category},{code},{brand},{price},{user},s-{user}" for time, kind, product, category, code, brand, price, user in fields]


def lines(spark, values, parts=2):
    return spark.createDataFrame([(v,) for v in values], "value string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_revenue_on_lines_and_on_curated_rows(spark, parts):
    raw = lines(spark, shop(), parts)
    want = [("501", 2495, 2, "24.95", "12.48"), ("630", 12000, 1, "120.00", "120.00"), ("702", 125, 1, "1.25", "1.25")]
    assert sorted(map(tuple, revenue.revenue_from_lines(raw).collect())) == want
    events = classify.curate(classify.parse_events(raw))
    assert sorted(map(tuple, revenue.revenue(events).collect())) == want
    reasons = {r.reason: r.n_rows for r in classify.reason_counts(classify.classify_purchases(raw), "reason").collect()}
    assert reasons == {"VALID_PURCHASE": 4, "NON_PURCHASE": 7, "HEADER": 1}
    by_root = {r.group_key: r.sum_minor for r in revenue.revenue_from_lines(raw, "category_root").collect()}
    assert by_root == {"light": 2495, "textile": 12000, S.UNKNOWN: 125}
    assert revenue.revenue_from_lines(raw.limit(0)).count() == 0


def line(kind="purchase", category="12", code="home.lamp", brand="acme", price="3.20", *rest):
    return ",".join(["2020-02-03 04:05:06 UTC", kind, "p7", category, code, brand, price, *(rest or ("u9", "s4"))])


def by_rule(kind, price, category):
    """The first rule that a well-formed line breaks: type, price, group."""
    if kind not in S.EVENT_TYPES:
        return "UNKNOWN_EVENT"
    if kind != "purchase":
        return "NON_PURCHASE"
    return "INVALID_PRICE" if price != "7.5" else "VALID_PURCHASE" if category == "88" else "INVALID_GROUP"


#: Every order of broken rules; every number of fields; quotes that close and quotes that don't; fields of many kilobytes.
LINES = {line(k, c, price=p): by_rule(k, p, c) for k in (*S.EVENT_TYPES, "refund", "") for p in ("7.5", "7.505", "-1", "seven") for c in ("88", "", "8x")}
LINES |= {",".join(["q"] * n): "UNKNOWN_EVENT" if n == 9 else "MALFORMED_CSV" for n in range(1, 14)}
LINES |= {classify.HEADER: "HEADER", "\ufeff" + classify.HEADER: "HEADER", classify.HEADER + ",more": "MALFORMED_CSV", "": "MALFORMED_CSV"}
LINES |= {line(brand=f'"{b}"'): "VALID_PURCHASE" for b in (",", ",,,", '""', 'a""b""', "plain", "", "\t")} | {line(brand=b): "MALFORMED_CSV" for b in ('"', '"open, to the end', '"shut"late', '"a"" ')}
LINES |= {line() + "\r": "VALID_PURCHASE", line() + "\r\r": "MALFORMED_CSV", line(brand='in"side'): "VALID_PURCHASE", line(" purchase ", " 12 "): "VALID_PURCHASE"}
LINES |= {
    line(brand="x" * 70_000): "MALFORMED_CSV", line(brand='"' + "y" * 60_000 + '"'): "VALID_PURCHASE", line(brand='"' + "y" * 60_000): "MALFORMED_CSV",
    line(brand='"' + '""' * 20_000 + '"'): "VALID_PURCHASE", line(brand='"' + '""' * 20_000): "MALFORMED_CSV", line(brand='"' + "y," * 20_000 + '"'): "VALID_PURCHASE",
}


def test_reasons_of_lines(spark):
    got = {r.value: r.reason for r in classify.classify_purchases(lines(spark, LINES)).collect()}
    assert {k: (v, got[k]) for k, v in LINES.items() if got[k] != v} == {}
    root = classify.classify_purchases(lines(spark, [line(code="")]), "category_root").first()
    assert (root.reason, root.group_key) == ("VALID_PURCHASE", S.UNKNOWN)


def test_fields_survive_quoting(spark):
    """Whatever a CSV writer quotes is read back as it was."""
    rnd = random.Random(4)
    rows = {f"{i}": ["2020-02-03 04:05:06 UTC", "purchase", f"{i}", "5", *("".join(rnd.choices('ab,"\té ', k=rnd.randint(1, 9))).strip() or "c" for _ in range(2)), "1", "u", "s"] for i in range(300)}
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows.values())
    back = {r.product_id: [r.category_code, r.brand] for r in classify.parse_lines(lines(spark, text.getvalue().splitlines())).collect()}
    assert back == {k: v[4:6] for k, v in rows.items()}


def test_fewer_fields_give_the_same_answers(spark):
    """The four fields of the revenue policy and all nine agree on every line."""
    raw = lines(spark, LINES)
    few, all_ = (classify.parse_lines(raw, fields=f).select("value", "well_formed", "is_header", *classify.REVENUE_FIELDS) for f in (classify.REVENUE_FIELDS, classify.FIELDS))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, all_.collect()), key=str)
    row = classify.parse_lines(lines(spark, [line(brand='"the ""big"", lamp"')])).first()
    assert (row.brand, row.price, row.user_session) == ('the "big", lamp', "3.20", "s4")


def test_money_texts(spark):
    valid = {"8.250": 825, "3e1": 3000, "+2.5": 250, "0": 0, " 9 ": 900}
    bad = ["4.005", "NaN", "Infinity", "-2", "", "y"]
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in [*valid, *bad]], "t string").select("t", S.money_minor("t").alias("m")).collect()}
    assert got == valid | dict.fromkeys(bad)
    row = spark.range(1).select(S.money_text(F.lit(5)).alias("a"), S.money_text(F.lit(123_456_789_012_345_678)).alias("b"), S.average_minor(F.lit(1), F.lit(2)).alias("c"), S.average_minor(F.lit(9_000_000_000_000_000_001), F.lit(2)).alias("d"), S.average_minor(F.lit(0), F.lit(0)).alias("e")).first()
    assert tuple(row) == ("0.05", "1234567890123456.78", 1, 4_500_000_000_000_000_001, None)


def test_curation_rejects_and_quality(spark):
    good = "2019-10-01 00:00:00 UTC,view,p1,1,a.b,b,1.00,u1,s1"
    rows = [classify.HEADER, good, good, "2019-10-01 00:00:01 UTC,cart,p1,1,,,1.00,u1,", "2019-10-01 00:00:02 UTC,purchase,p1,1,a.b,b,1.00,u1,s1", "2019-02-30 00:00:00 UTC,view,p1,1,a,b,1,u,s",
            "2019-10-01 00:00:00 UTC,other,p1,1,a,b,1,u,s", "2019-10-01 00:00:00 UTC,view,,1,a,b,1,u,s", "2019-10-01 00:00:00 UTC,view,p,1,a,b,1.234,u,s", "2019-10-01 00:00:00 UTC,view,p,1,a,b,1,,s", "nonsense"]
    parsed = classify.parse_events(lines(spark, rows))
    counts = {r.reason: r.n_rows for r in classify.reason_counts(parsed).collect()}
    assert counts == {"VALID": 4, "HEADER": 1, "INVALID_EVENT_TIME": 1, "UNKNOWN_EVENT_TYPE": 1, "MISSING_PRODUCT_ID": 1, "INVALID_PRICE": 1, "MISSING_USER_ID": 1, "MALFORMED_CSV": 1}
    events = classify.curate(parsed)
    p = quality.profile(events).first()
    assert (p.n_rows, p.null_category_code, p.null_brand, p.null_user_session) == (4, 1, 1, 1)
    assert tuple(quality.duplicates(events).first()) == (1, 1)
    assert quality.conservation(parsed, events).first().rejected == 7
    with pytest.raises(Exception, match="rows were lost"):
        quality.conservation(parsed, events.limit(1)).collect()


def test_funnels_and_trend(spark):
    events = classify.curate(classify.parse_events(lines(spark, shop())))
    f = {r.category_id: (r.views, r.carts, r.purchases, r.revenue_minor, r.view_to_purchase, r.cart_to_purchase) for r in metrics.funnel_by_category(events).collect()}
    assert f == {"501": (3, 1, 2, 2495, 0.666667, 2.0), "630": (0, 1, 1, 12000, None, 1.0), "702": (1, 0, 1, 125, 1.0, None)}
    hours = {(str(r.event_date), r.event_hour): (r.events, r.distinct_users) for r in metrics.trend_by_hour(events).collect()}
    assert hours == {("2020-01-05", 8): (4, 2), ("2020-01-05", 9): (2, 1), ("2020-01-06", 9): (5, 2)}
    assert {r.brand: (r.purchases, r.revenue_minor) for r in metrics.funnel_by_brand(events).collect()} == {"orbi": (1, 1990), "weft": (1, 12000), S.UNKNOWN: (2, 630)}
    with pytest.raises(Exception, match="totals differ"):
        metrics.totals_check(events, metrics.funnel_by_category(events), revenue.revenue(events.where("category_id <> '702'"))).collect()


def event(day, kind, product, price="10.00", user="u1"):
    return f"{day} 00:00:00 UTC,{kind},{product},1,a.b,b,{price},{user},s"


def test_features_and_labels(spark):
    rows = [event("2019-10-01", "view", "p1"), event("2019-10-02", "view", "p1", user="u2"), event("2019-10-01", "view", "p2"), event("2019-10-02", "view", "p2"),
            event("2019-10-03", "purchase", "p1"), event("2019-10-04", "view", "p2"), event("2019-10-05", "purchase", "p2"), event("2019-10-05", "view", "p1")]
    events = classify.curate(classify.parse_events(lines(spark, rows)))
    got = {r.product_id: r for r in features.snapshot(events, "2019-10-03", 2, 1, 2, "train").collect()}
    assert (got["p1"].label, got["p1"].purchases, got["p1"].recent_view_share) == (1, 0, 0.5)
    assert got["p2"].label == 0 and got["p1"].split == "train"
    assert features.coverage(events, "2019-10-03", 2, 1).count() == 1
    with pytest.raises(Exception, match="not covered"):
        features.coverage(events, "2019-10-05", 2, 3).collect()
    with pytest.raises(ValueError):
        features.label_table(events, "2019-10-03", "2019-10-03", 2, 1, 2)


def test_windows_prune_date_partitions(spark, tmp_path):
    from tallyforge.sources import writers

    events = classify.curate(classify.parse_events(lines(spark, [event(f"2019-10-0{d}", "view", "p") for d in range(1, 8)])))
    path = writers.write_curated(events, str(tmp_path), "r1")
    with pytest.raises(Exception, match="already exists"):
        writers.write_curated(events, str(tmp_path), "r1")
    plan = features.between(spark.read.parquet(path), "2019-10-02", "2019-10-04")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert features.between(spark.read.parquet(path), "2019-10-02", "2019-10-04").count() == 2


def test_parity_validation_and_dictionary(spark):
    a = revenue.revenue_from_lines(lines(spark, shop()))
    b = a.where("group_key = '630'").withColumn("sum_minor", F.lit(1).cast("bigint"))
    assert tuple(compare.parity(a, b).first()) == (3, 1, 2, 0, 1)
    assert [r.group_key for r in compare.first_differences(a, b).collect()] == ["501", "630", "702"]
    assert compare.validate(a, 4).first().purchases == 4
    with pytest.raises(Exception, match="not valid"):
        compare.validate(a.unionByName(a), 8).collect()
    words = catalog.dictionary(a)
    assert [tuple(r) for r in words.orderBy("dense_id").collect()] == [("501", 0), ("630", 1), ("702", 2)]
    assert compare.missing_keys(spark.createDataFrame([("9",)], "group_key string"), words).count() == 1
    with pytest.raises(Exception, match="missing in the dictionary"):
        compare.looked_up(spark.createDataFrame([("9",)], "group_key string"), words).collect()
    with pytest.raises(Exception, match="too many groups"):
        catalog.group_profile(lines(spark, shop()), max_keys=1).collect()


def test_samples_do_not_depend_on_partitioning(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    one, many = (sorted(r.k for r in catalog.sample_entities(rows.repartition(n), "k", 0.1).collect()) for n in (1, 7))
    assert one == many and 400 < len(one) < 600


@pytest.mark.parametrize("mode,skew,groups", [("uniform", 0.0, 5), ("skew", 1.0, 1), ("cardinality", 0.0, 600)])
def test_workload(spark, mode, skew, groups):
    out = readers.workload(spark, 600, 5, mode, skew)
    assert out.count() == 600 and revenue.revenue_from_lines(out).count() == groups
    assert sorted(r.value for r in out.collect()) == sorted(r.value for r in readers.workload(spark, 600, 5, mode, skew).repartition(3).collect())
