"""Personal data and secrets: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is a column expression. Patterns use possessive repetition, so that Java matches them in one pass
without recursion whatever the text's length, and each may start only where an earlier start cannot exist.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of output, with their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32})(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
}
#: What each match holds: one of these strings, and a digit if the kind is numeric. A text without is not searched.
NEEDS = {"email": ["@"], "ip": ["."], "phone": ["+"], "ssn": ["-"], "key": ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "-----BEGIN "]}
NUMERIC = ("ip", "card", "phone", "iban", "ssn", "secret")
#: Kinds that count as secrets.
SECRETS = ("key", "secret")
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and words that raise it when they stand shortly before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3, "key": 0.9, "secret": 0.2}
CONTEXT = {
    "email": "e-?mail|mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|mastercard|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|tax id|\bnin\b",
    "key": "key|token|secret",
    "secret": r"api.?key|access.?key|secret|token|passw(?:or)?d|\bpwd\b|credential|bearer",
}
REACH, CONTEXT_BONUS, ACCEPT, BLOCK = 40, 0.3, 0.5, 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _mod97(code: Column) -> Column:
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c <= 57, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern passes its validator."""
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(hit, r"\."), lambda p: F.when(bare(p) == "", True).when(F.length(bare(p)) <= 3, bare(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(13, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        code = F.regexp_replace(hit, " ", "")
        return F.when(F.length(code).between(15, 34), _mod97(code)).otherwise(F.lit(False))
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """Whether a text may hold a span of the kind: what a match needs, context if no score is enough without it, and then the pattern."""
    tests = [reduce(or_, (F.contains(text, F.lit(n)) for n in NEEDS[kind]))] if kind in NEEDS else []
    if kind not in BASE and SCORES[kind] < ACCEPT:
        tests.append(F.lower(text).rlike(CONTEXT[kind]))
    return reduce(and_, [*tests, text.rlike(PATTERNS[kind])])


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, in order: array of (kind, start, end, score), in code points.

    The pieces between matches give the positions: each match starts where the pieces and matches before it end.
    They are summed block by block, so that appending stays cheap in a text of very many matches. Context is
    what stands within REACH code points before a match and after the match before it.
    """
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string>>)")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"), F.right(pair["gap"], F.lit(REACH)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def block(state: Column, number: Column) -> Column:
        pairs = F.slice(state["pairs"], number * BLOCK + 1, F.lit(BLOCK))
        part = F.aggregate(pairs, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        return F.struct(part["at"].alias("at"), F.concat(state["found"], part["found"]).alias("found"), state["pairs"].alias("pairs"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("found"), pairs.alias("pairs")), block)["found"]
    kept = F.filter(placed, lambda s: _confirmed(kind, s["hit"]))

    def scored(s: Column) -> Column:
        near = F.lower(s["before"]).rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.filter(F.transform(kept, scored), lambda s: s["score"] >= ACCEPT)


def find_pii(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """Add one column per kind, `pii_<kind>`: array of (kind, start, end, score), ordered by start.

    Spans of a kind never overlap; those of different kinds may. `start` and `end` count code points, end
    exclusive. Base kinds keep every confirmed match; the kinds the method adds (iban, ssn, key, secret) need the score
    ACCEPT, which for ssn and secret takes a context word. A null text counts as empty and has no spans; columns of
    these names are replaced, all others stay as they are. Repeated rows are searched row by row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    columns = {}
    for kind in PATTERNS:
        found = F.when(_worth(kind, text), _spans(kind, text)).otherwise(none)
        columns[prefix + kind] = F.when(text.rlike("[0-9]"), found).otherwise(none) if kind in NUMERIC else found
    return docs.withColumns(columns)


def scores(spans: Column) -> Column:
    """The score of each span with two decimals, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def digest(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas; no span gives an empty string."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
