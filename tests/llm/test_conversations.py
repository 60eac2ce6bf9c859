import hashlib
import random
import re
import zlib

import pytest

from rigscope.llm import conversations as cv
from rigscope.llm import queries

KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = (2, 2, 3, 2)


def cheapest(rows):
    """Least (cost, audit, lines) by plain dynamic programming over rows and states, forwards."""
    best = {0: (0, "", ())}

    def inserts(b):
        for _ in range(4):
            for s, (c, a, t) in list(b.items()):
                x = (c + 2, a + "I", (*t, ("user" if NEXT[s] == 2 else "assistant") + ":"))
                b[NEXT[s]] = min(b.get(NEXT[s], x), x)
        return b

    for role, text, fault in rows:
        new = {}
        for s, (c, a, t) in inserts(dict(best)).items():
            more = [(s, (c + 3, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if s in KEEP.get(role[:1], {}):
                    more.append((KEEP[role[:1]][s], (c + extra, a + "K", (*t, f"{role}:{text}"))))
                more.append((NEXT[s], (c + 2 + extra, a + "R", (*t, ("user" if NEXT[s] == 2 else "assistant") + f":{text}"))))
            for n, x in more:
                new[n] = min(new.get(n, x), x)
        best = new
    end = inserts(dict(best))
    return min(end[s] for s in (0, 3) if s in end)


def contract(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            name = ":".join(" " if x is None else str(x) for x in (conv, turn))
            role, text, h = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            x = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not x else "duplicate" if (role, text) in seen else "truncated" if x[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed):
    g = random.Random(seed)
    text = lambda: g.choice(["Yes.", "No!", "why", " ", "", "a b.", "Ça va? ", "long text . \n", "x　", None])
    role = lambda: g.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
    rows = []
    for c in range(150):
        for t in range(g.randrange(1, 9)):
            rows.append((c, g.choice([t, t, t, t + 3, None]), role() if g.random() < 0.4 else "ua"[t % 2].replace("u", "user").replace("a", "assistant"), text() if g.random() < 0.5 else f"text {g.randrange(5)} ."))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (500, None, "user", None), (501, 5, "user", "Hi."), (501, 5, "user", "Hi."), (501, 5, "assistant", "Hi.")]
    rows += [(777, t, "user" if t % 7 else "assistant", f"t {t % 50}.") for t in range(600)]
    rows += [(778, t, g.choice(["user", "assistant", "system"]), f"t {t}") for t in range(300)]
    return rows


def query(spark, rows, folder, **more):
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, report string").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op11_conversation_repair(spark, str(folder)).collect()), key=repr)


@pytest.mark.parametrize("runs", [cv.PIECE_RUNS, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, runs):
    monkeypatch.setattr(cv, "PIECE_RUNS", runs)
    rows = talks(1)
    assert query(spark, rows, tmp_path) == contract(rows)


def test_all_dropped_and_empty(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (got,) = query(spark, [(gone, 0, "user", "Hi.")], tmp_path)
    assert got == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert query(spark, [], tmp_path / "none") == []


def test_long_runs_by_powers():
    """Runs of many equal symbols cost and read as row-by-row dynamic programming says, in every state."""
    g = random.Random(2)
    role, fault = ("system", "user", "assistant", "tool"), (None, "truncated")
    for _ in range(150):
        runs = [(g.randrange(9), g.choice([1, 2, 3, 7, 8, 30])) for _ in range(g.randrange(1, 7))]
        rows = [("user", "", "blank") if s == cv.GONE else (role[s % 4], "", fault[s // 4]) for s, n in runs for _ in range(n)]
        cost, audit, _ = cheapest(rows)
        (a,), (end,), (c,) = cv.audited(runs, cv.END, range(1))
        assert (c + 2 * len(cv.CLOSING[end]), a + cv.CLOSING[end]) == (cost, audit)
    (a,), _, (c,) = cv.audited([(1, 1_000_000)], cv.END, range(1))
    assert len(a.replace("I", "")) == 1_000_000 and c == 2 * (a.count("I") + a.count("R")) + 3 * a.count("D") and c < 1_000_001
    assert cv.times(tuple(tuple(cv.matrix([(1, 5), (6, 70)])[4 * s : 4 * s + 4]) for s in range(4)), cv.END) == cv.before(1, 5, cv.before(6, 70, cv.END))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Again."), (2, 0, "assistant", "So.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = cv.repair(df).orderBy("conv_id", "place").collect()
    said = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in out if r["report"] is None]
    assert said == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "R", "assistant", "Again."), (2, "I", "user", ""), (2, "K", "assistant", "So.")]
    assert {r["conv_id"]: r["report"]["audit"] for r in out if r["report"]} == {1: "KKDR", 2: "IK"}
