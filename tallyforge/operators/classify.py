"""From text lines to typed events, with one stated reason for each line that is not used.

Two policies exist on purpose: revenue looks at a purchase's price and group alone, the curated table asks for
more of every event. Both are chains of column expressions over one parse, so Spark prunes what isn't asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

#: The fields of a line in order, which also are the header.
FIELDS = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")
HEADER = ",".join(FIELDS)
#: The fields that the revenue policy looks at.
REVENUE_FIELDS = ("event_type", "category_id", "category_code", "price")
MAX_LINE_BYTES = 65_536
#: Possessive throughout, so that a field of any length is matched without recursion and never taken back.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"\s*+|[^",][^,]*+|)'
_ROW = rf"^{_FIELD}(?:,{_FIELD}){{8}}\z"
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def bare_line(line: Column | str) -> Column:
    """The line without one trailing CR and without a byte-order mark."""
    return F.regexp_replace(F.regexp_replace(S.as_column(line), r"\r\z", ""), "^\ufeff", "")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: filters above don't copy their expressions below a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_lines(lines: DataFrame, line_col: str = "value", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add `well_formed`, `is_header` and the text fields asked for (empty text for a missing one).

    A line without quotes is split at its commas; only lines with quotes are matched against the pattern of nine
    fields and read as CSV. Which fields are asked for changes no answer.
    """
    bare = _once(lines, _bare=bare_line(line_col))
    parts = _once(bare, _quoted=F.contains("_bare", F.lit('"')), _parts=F.split("_bare", ",", -1))
    nine = F.when(F.col("_quoted"), F.col("_bare").rlike(_ROW)).otherwise(F.size("_parts") == len(FIELDS))
    fine = (F.octet_length("_bare") <= MAX_LINE_BYTES) & ~F.col("_bare").rlike("[\r\n]") & nine
    quoted = F.from_csv("_bare", F.lit(_SCHEMA), {"mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"})
    pick = lambda row, at: F.struct(*[at(row, f).alias(f) for f in fields])
    plain = pick(F.col("_parts"), lambda row, f: row[FIELDS.index(f)])
    judged = _once(parts, well_formed=F.coalesce(fine, F.lit(False)), is_header=F.coalesce(F.col("_bare") == HEADER, F.lit(False)))
    csv = _once(judged, _csv=F.when(F.col("well_formed") & F.col("_quoted"), quoted))
    row = F.when(F.col("_quoted"), pick(F.col("_csv"), lambda row, f: row[f])).otherwise(plain)
    out = _once(csv, _row=F.when(F.col("well_formed"), row))
    return out.withColumns({f: F.when(F.col("well_formed"), F.coalesce(F.col(f"_row.{f}"), F.lit(""))) for f in fields}).drop("_row", "_csv", "_parts", "_quoted", "_bare")


def revenue_reason(mode: str = "category_id") -> Column:
    """The revenue policy's reason for a parsed line; the price of what isn't a purchase is never looked at."""
    kind = F.trim("event_type")
    return (
        F.when(F.col("is_header"), "HEADER")
        .when(~F.col("well_formed"), "MALFORMED_CSV")
        .when(~kind.isin(*S.EVENT_TYPES), "UNKNOWN_EVENT")
        .when(kind != "purchase", "NON_PURCHASE")
        .when(S.money_minor("price").isNull(), "INVALID_PRICE")
        .when(S.group_key(mode, "category_id", "category_code").isNull(), "INVALID_GROUP")
        .otherwise("VALID_PURCHASE")
    )


def curation_reason() -> Column:
    """The curated table's reason to reject a parsed line; null for a line that is kept."""
    return (
        F.when(~F.col("well_formed"), "MALFORMED_CSV")
        .when(F.col("is_header"), "HEADER")
        .when(S.event_time("event_time").isNull(), "INVALID_EVENT_TIME")
        .when(~S.known_event("event_type"), "UNKNOWN_EVENT_TYPE")
        .when(F.col("product_id") == "", "MISSING_PRODUCT_ID")
        .when(F.col("user_id") == "", "MISSING_USER_ID")
        .when(S.money_minor("price").isNull(), "INVALID_PRICE")
    )


def classify_purchases(lines: DataFrame, mode: str = "category_id", line_col: str = "value") -> DataFrame:
    """Parsed lines with `reason`, and `group_key` and `price_minor` where the reason is VALID_PURCHASE."""
    rows = _once(parse_lines(lines, line_col, REVENUE_FIELDS), reason=revenue_reason(mode))
    valid = F.col("reason") == "VALID_PURCHASE"
    return rows.withColumns({"group_key": F.when(valid, S.group_key(mode, "category_id", "category_code")), "price_minor": F.when(valid, S.money_minor("price"))})


def parse_events(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """All lines with `reject_reason` and the typed event columns."""
    rows = _once(parse_lines(lines, line_col), reject_reason=curation_reason())
    code = S.blank_to_null("category_code")
    return rows.select(
        "reject_reason",
        S.event_time("event_time").alias("event_time"),
        F.trim("event_type").alias("event_type"),
        "product_id",
        S.blank_to_null("category_id").alias("category_id"),
        code.alias("category_code"),
        S.category_root(code).alias("category_root"),
        S.blank_to_null("brand").alias("brand"),
        (S.money_minor("price").cast("decimal(38,0)") / 100).cast("decimal(12,2)").alias("price"),
        S.money_minor("price").alias("price_minor"),
        "user_id",
        S.blank_to_null("user_session").alias("user_session"),
    )


def curate(parsed: DataFrame) -> DataFrame:
    """The accepted events with `event_date` and `event_hour`."""
    kept = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return kept.withColumns({"event_date": F.to_date("event_time"), "event_hour": F.hour("event_time")})


def reason_counts(rows: DataFrame, reason_col: str = "reject_reason") -> DataFrame:
    """Rows per reason, with VALID for those without one."""
    return rows.groupBy(F.coalesce(F.col(reason_col), F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n_rows"))


def missing_codes(classified: DataFrame) -> DataFrame:
    """How many valid purchases have no category code."""
    blank = F.trim("category_code") == ""
    return classified.agg(F.count_if((F.col("reason") == "VALID_PURCHASE") & blank).alias("missing_codes"))
