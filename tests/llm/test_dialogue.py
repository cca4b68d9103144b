import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import dialogue
from tallyforge.llm.queries import op13_dialogue

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, note string"


def damage(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Gaps, faults, cost, audit and repaired hash of one conversation, from the end to the start over whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = text.strip(WHITE)
        faults.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    ahead = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted=0):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            cost, edits = best(i, ahead[state], inserted + 1)
            ways.append((cost + 3, "I" + edits))
        if i < len(rows):
            role, fault = rows[i][2][:1], faults[i]
            cost, edits = best(i + 1, state)
            ways.append((cost + 4, "D" + edits))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                cost, edits = best(i + 1, ahead[state])
                ways.append((cost + 3 + more, "R" + edits))
                if role == ahead[state] or role == "s" and state == "":
                    cost, edits = best(i + 1, role)
                    ways.append((cost + more, "K" + edits))
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "")
    left, state, waiting = [], "", list(rows)
    for e in audit:
        row = waiting.pop(0) if e != "I" else (0, 0, "", "")
        if e == "D":
            continue
        state = row[2][:1] if e == "K" else ahead[state]
        left.append(f"{row[2] if e == 'K' else 'user' if state == 'u' else 'assistant'}:{row[3]}")
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


def as_table(spark, rows):
    return spark.createDataFrame([(*r[:4], "note") for r in rows], SCHEMA)


def expected(rows, convs):
    out = {}
    for conv in convs:
        out[conv] = brute([r for r in rows if r[0] == conv])
    return out


def got(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ü"])
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why?", "x. \n", f"own {turn}.", "é"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed,convs,most", [(1, 300, 6), (2, 60, 40), (3, 4, 220)])
def test_equals_brute_force(spark, seed, convs, most):
    rows = random_rows(seed, convs, most)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(dialogue.summaries(as_table(spark, rows).repartition(5))) == expected(clean, range(convs))


def test_damage_and_query_equal_brute_force(spark, small):
    told = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in told.collect()]
    assert got(op13_dialogue(spark, small)) == expected(damage(rows), {r[0] for r in rows})


def test_damage_of_odd_rows(spark):
    rows = [(c, t, r, x) for c in (None, *range(30)) for t, r, x in [(None, None, None), (0, "user", "a. b? c!"), (0, "user", "a. b? c!"), (5, "system", ""), (7, "assistant", "ok.")]]
    out = dialogue.damaged(as_table(spark, rows))
    assert sorted(map(repr, ((r.conv_id, r.turn, r.role, r.text) for r in out.where("present").collect()))) == sorted(map(repr, damage(rows)))
    assert got(dialogue.summaries(out, "present")) == expected(damage(rows), {r[0] for r in rows})


def test_all_rows_dropped(spark):
    rows = as_table(spark, [(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")]).withColumn("present", F.col("conv_id") == 2)
    out = got(dialogue.summaries(rows, "present"))
    assert out[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out[2][5:7] == (3, "KI")
    assert dialogue.repaired(rows, "present").where("conv_id = 1").count() == 0


def test_messages_are_what_the_edits_leave(spark):
    rows = random_rows(9, 40, 30)
    whole = got(dialogue.summaries(as_table(spark, rows)))
    edits = {}
    for r in dialogue.repaired(as_table(spark, rows)).orderBy("conv_id", "place").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, (*_, audit, digest) in whole.items():
        own = edits.get(conv, [])
        assert "".join(r.edit for r in own) == audit and [r.place for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == digest
        assert all(r.turn is None for r in own if r.edit == "I")


def test_edits_come_out_while_the_conversation_runs():
    """A long sound stretch is emitted on the way, so that little waits; a parity conflict waits as long as it is open."""
    search, out = dialogue.Survivors(), ""
    for at in range(20_000):
        out += search.step(dialogue.SOUND, "ua"[at % 2])
        assert search.ways[dialogue.ASSISTANT][1].depth - search.root.depth <= 2 * dialogue.WAIT + 4
    cost, rest = search.end()
    assert cost == 0 and out + rest == "K" * 20_000 and len(rest) <= 2 * dialogue.WAIT


def test_blank_stretches_leave_few_nodes():
    """Ways that delete all rows share their ancestors, whichever state they are in."""
    search, out = dialogue.Survivors(), ""
    for _ in range(5_000):
        out += search.step(dialogue.BLANK, "u")
        assert search.ways[dialogue.ASSISTANT][1].depth - search.root.depth <= 4 * dialogue.WAIT
    assert search.end()[0] == 20_000


def test_empty_table_and_long_text(spark):
    assert dialogue.summaries(as_table(spark, [])).count() == 0 and dialogue.repaired(as_table(spark, [])).count() == 0
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "x")]
    assert got(dialogue.summaries(as_table(spark, rows))) == expected(rows, [1])


def test_clashing_columns_and_text_ids(spark):
    rows = as_table(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")])
    more = rows.withColumns({"there": F.lit(False), "fault": F.lit(9), "again": F.lit(True), "edit": F.lit("x"), "conv_id": F.lit("a")})
    out = dialogue.summaries(more).first()
    assert (out.conv_id, out.cost, out.audit) == ("a", 0, "KK")
