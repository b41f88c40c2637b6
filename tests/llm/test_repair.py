"""Conversation repair against a plain table of least (cost, audit) per row and state, and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from brightwater.llm import repair
from brightwater.llm.oracles import ORACLES
from brightwater.llm.queries import op12_repair

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """{conv: rows after damage in order} of (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        shown = lambda v: " " if v is None else v
        harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def mended(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)"""
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by what has been said last: nothing, s, u, a

    def offer(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserts(at):
        for _ in range(3):
            for state, (cost, audit, said) in list(at.items()):
                nxt = "a" if state == "u" else "u"
                offer(at, nxt, (cost + 5, audit + "I", (*said, ("user:" if nxt == "u" else "assistant:"))))

    for (_, role, text), fault in zip(turns, faults):
        inserts(best)
        after = {}
        for state, (cost, audit, said) in best.items():
            offer(after, state, (cost + 2, audit + "D", said))
            if fault in "bd":
                continue
            cost += 5 * (fault == "t")
            for initial in ("s", "u", "a"):
                if (state, initial) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    continue
                if role[:1] == initial:
                    offer(after, initial, (cost, audit + "K", (*said, f"{role}:{text}")))
                if initial != "s":
                    offer(after, initial, (cost + 1, audit + "R", (*said, f"{'user' if initial == 'u' else 'assistant'}:{text}")))
        best = after
    inserts(best)
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def held(frame, rows):
    out = repair.repair(repair.damage(frame), frame.select(F.col("conv_id").alias("conv"))).collect()
    want = {c: mended(t) for c, t in damaged(rows).items()}
    assert len(out) == len(want) and {r.conv: tuple(r)[1:] for r in out} == want


def table(spark, rows, key="long"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"conv_id {key}, turn long, role string, text string, audit string, seq int").repartition(3)


def some_rows(seed, convs=60):
    r = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", "What?", "so ! ", "a.b", "Yes.", None, "é ", "long " * 30 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux", "User"]
    return [(c if c else None, r.choice([None, *range(12)]) if c % 3 == 0 else t, r.choice(roles[: 2 + r.randrange(9)]), r.choice(texts)) for c in range(convs) for t in range(r.randrange(1, 14))]


def test_search_alone():
    """Every order of faults and roles up to five rows, from every state, is no dearer than by the plain table."""
    r = random.Random(1)
    words = {"-": "ok.", "t": "ok", "b": " "}
    for _ in range(1500):
        own = [(i, r.choice(["system", "user", "assistant", "tool"]), words[f] + (f"{i}." if f == "-" else str(i) if f == "t" else "")) for i, f in enumerate(r.choices("--tb", k=r.randrange(6)))]
        steps = "".join((role[0] if role[0] in "sua" else "-") + ("b" if not text.strip() else "t" if text[-1] not in ".!?" else "-") for _, role, text in own)
        *_, cost, audit, _ = mended(own)
        assert repair.cheapest(steps)[::2] == (cost, audit)


@pytest.mark.parametrize("bits", [10, 1])
def test_against_plain(spark, monkeypatch, bits):
    """Whole conversations, and conversations in parts of two rows; nulls, ties, repeats, odd roles, clashing names."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = some_rows(bits)
    rows += [rows[3]] * 3 + [(777, 5, "user", "Same.")] * 9 + [(778, None, None, None)] * 4 + [(2**60 + 1, t, "tool", "Hm") for t in (5, 900, 7)]
    held(table(spark, rows), rows)


def test_long_conversation(spark):
    """One conversation holds most rows and is searched in parts."""
    r = random.Random(3)
    rows = [(5, t, ["user", "assistant", "assistant"][t % 2 + (r.random() < 0.1)], r.choice(["Well.", "cut", f"Line {t}."]) + ("" if r.random() < 0.3 else f" {t}!")) for t in range(0, 7000, 2)]
    rows += [(c, t, "user", "Hi.") for c in range(20) for t in range(3) if c != 5]
    held(table(spark, rows, "int"), [tuple(x) for x in rows])


def test_empty_and_text_keys(spark):
    none = table(spark, [])
    assert repair.repair(repair.damage(none), none.select(F.col("conv_id").alias("conv"))).collect() == []
    gone = [(str(i), 0, "user", "Hi.") for i in range(60)]
    rows = [r for r in gone if zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0]
    out = repair.repair(repair.damage(table(spark, rows, "string")), table(spark, rows, "string").select(F.col("conv_id").alias("conv"))).collect()
    assert rows and {tuple(r)[1:] for r in out} == {(0, 0, 0, 0, 0, 0, "", repair.EMPTY)} and len(out) == len(rows)


def test_turns(spark, monkeypatch):
    """The repaired rows, in order, hash to the summary's digest."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    harmed = repair.damage(table(spark, some_rows(8)))
    said = {}
    for r in repair.repaired_turns(harmed).orderBy("conv", "seq", "place").collect():
        said.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    for r in repair.repair(harmed).collect():
        assert hashlib.sha256("\n".join(said.get(r.conv, [])).encode()).hexdigest() == r.repaired_sha256


def test_query_against_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    out = op12_repair(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(duck.sql(ORACLES["op12_repair"]).select(", ".join(out.columns)).fetchall())
