"""Conversation repair against plain recursion over whole conversations."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from paginarium.llm import dawg

sys.setrecursionlimit(20_000)
WHITE = " \t\n\x0b\f\r"
NEXT = {0: "su", 1: "u", 2: "a", 3: "u"}
TO = {"s": 1, "u": 2, "a": 3}


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit; rows are (role, text, fault)."""

    @lru_cache(None)
    def of(k, state, inserts):
        found = [(0, "", ())] if k == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in NEXT[state]:
                    c, a, t = of(k, TO[role[0]], inserts + 1)
                    found.append((c + 5, "I" + a, ((role, ""), *t)))
        if k < len(rows):
            role, text, fault = rows[k]
            c, a, t = of(k + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                price = 5 * (fault == "truncated")
                for given, cost, name in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if given[:1] in tuple(NEXT[state]):
                        c, a, t = of(k + 1, TO[given[0]], 0)
                        found.append((c + cost + price, name + a, ((given, text), *t)))
        return min(found) if found else (1 << 50, "", ())

    return of(0, 0, 0)


def brute(table):
    out = []
    for conv in {c for c, *_ in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            said = lambda x: " " if x is None else str(x)
            h = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if h == 1:
                text = ""
            elif h == 2:
                text = "".join(x for x in text if x not in ".!?")
            elif h == 4:
                role = "user"
            rows += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text)] * ((h != 0) + (h == 3))
        rows.sort()
        seen, faulted = set(), []
        for _, _, role, _, text in rows:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faulted.append((role, text, fault))
        turns = {t for has, t, *_ in rows if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulted, faulted[1:]))
        cost, audit, repaired = cheapest(tuple(faulted))
        n = lambda what: sum(f == what for *_, f in faulted)  # noqa: E731, B023
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(r.choice([1, 2, 3, 5, 9])):
            if r.random() < 0.9:
                rows.append((conv, r.choice([turn, turn, turn, None, turn * 3]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "No?", "well", " \n", "", None, "Ünï!", "a. ", f"t{turn}."])))
    rows += [(None, t, "user", "hi.") for t in (1, 1, None)]
    rows += [(500, t, "user" if t % 2 else "assistant", f"line {t}." if t % 7 else "same.") for t in range(200)]
    rows += [(501, 2, "user", "Again.")] * 40
    rows += [(conv, 0, "user", "gone.") for conv in range(600, 690)]
    rows += [(700, 0, "user", "word " * 50_000 + "."), (700, 1, "assistant", "." * 100_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*row, k) for k, row in enumerate(conversations())]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, signs int").repartition(5)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk", [dawg.CHUNK, 3])
def test_repair_equals_recursion(spark, table, chunk, monkeypatch):
    monkeypatch.setattr(dawg, "CHUNK", chunk)
    found = dawg.repaired(spark, table)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    expected = brute(conversations())
    assert collected(found) == expected
    assert {c for c, *_ in expected} >= {None, 500, 501, 600, 700}
    assert any(row[1:8] == (0, 0, 0, 0, 0, 0, "") for row in expected)


def test_sql_agrees(spark, table, tmp_path):
    small = table.where("conv_id < 200 OR conv_id > 500 OR conv_id IS NULL")
    small.write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c.parquet/*.parquet')")
    expected = sorted(con.sql(dawg.ORACLE).fetchall(), key=str)
    assert collected(dawg.repaired(spark, small)) == expected


def test_empty_table(spark, table):
    assert dawg.repaired(spark, table.where("conv_id = -1")).count() == 0


def test_every_short_string_and_shared_rests():
    rests, computed = dawg.Rests(), []
    real = dawg.node
    for length in range(5):
        for string in product("suaoxUAO", repeat=length):
            rests.enter("".join(string))
            faults = {"x": "blank"}
            roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
            rows = tuple((roles[x.lower()], "t", faults.get(x, "truncated" if x.isupper() else "")) for x in string)
            cost, audit, _ = cheapest(rows)
            assert (rests.costs[-4], rests.audit()) == (cost, audit)
    strings = sorted(("".join(s) for s in product("sux", repeat=6)), key=lambda s: s[::-1])
    rests = dawg.Rests()
    try:
        dawg.node = lambda *a: computed.append(a) or real(*a)
        for s in strings:
            rests.enter(s)
    finally:
        dawg.node = real
    assert len(computed) == sum(3**k for k in range(1, 7))  # one for each distinct rest
