import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from plumbline.llm import conversation_repair as C

WELL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, h1 long, first string, new int, audit string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, kinds):
    """Cheapest edits over all choices, with up to two insertions anywhere."""
    best = None
    gaps = [p for k in range(3) for p in product("ua", repeat=k)]

    def walk(i, cost, audit, made):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more in gaps:
            c, a, m = cost + 5 * len(more), audit + "I" * len(more), made + [("user" if x == "u" else "assistant", "") for x in more]
            if i == len(rows):
                if WELL.match("".join(r[:1] if r[:1] else "-" for r, _ in m)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, m)
                continue
            role, text = rows[i]
            walk(i + 1, c + 2, a + "D", m)
            if kinds[i] not in ("b", "d"):
                extra = 5 * (kinds[i] == "t")
                walk(i + 1, c + extra, a + "K", m + [(role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, c + 1 + extra, a + "R", m + [(new, text)])

    walk(0, 0, "", [])
    return best


def brute(conversations):
    """The contract, row by row."""
    out = []
    for conv in {r[0] for r in conversations}:
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
            kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
            row = (turn, "user" if kind == 4 else said[2], "" if kind == 1 else re.sub("[.!?]", "", said[3]) if kind == 2 else said[3])
            rows += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        known = [r[0] for r in rows if r[0] is not None]
        kinds = faults([r[1:] for r in rows])
        cost, audit, made = every_repair([r[1:] for r in rows], kinds)
        illegal = sum((a[1][:1] or "-") + (b[1][:1] or "-") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((str(conv), max(known) - min(known) + 1 - len(set(known)) if known else 0, *[kinds.count(k) for k in "bdt"], illegal, cost, audit, digest))
    return sorted(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, -1, "x", 2, "clash") for r in rows], SCHEMA)


def test_equals_all_repairs(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(120), None]:
        for turn in rng.sample(range(9), rng.randrange(1, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "s", "usr"])
            rows.append((conv, turn if rng.random() < 0.95 or turn else None, role, rng.choice(["Yes.", "No!", "So", "Well? \n", None, "", " \t", "é", f"Text {rng.randrange(9)}."])))
    rows += [(500 + i, 0, "user", "Only.") for i in range(40)]  # some lose their only row
    rng.shuffle(rows)
    got = sorted((str(r[0]), *r[1:]) for r in C.damage_and_repair(conversations(spark, rows)).collect())
    want = brute(rows)
    assert got == want
    assert {"D", "K", "R"} <= set("".join(r[7] for r in want)) and any(r[7] == "" for r in want)


def test_search_equals_all_repairs():
    rng = random.Random(5)
    kinds = ["", "", "", "t", "b"]
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), str(i)) for i in range(rng.randrange(6))]
        fault = [rng.choice(kinds) for _ in rows]
        codes = [C.FORCED if f == "b" else "suat".index(r[0]) + 4 * (f == "t") for (r, _), f in zip(rows, fault, strict=True)]
        assert C.search(codes) == every_repair(rows, fault)[:2]
        assert C.lower_bounds(codes)[0][0] <= C.search(codes)[0]


def test_long_conversation_is_searched_in_proportion():
    rng = random.Random(6)
    codes = [rng.choice([C.USER, C.ASSISTANT, C.SYSTEM, C.USER + 4, C.FORCED]) for _ in range(60_000)]
    cost, audit = C.search(codes)
    edits = audit.replace("I", "")
    assert len(edits) == len(codes)
    spent = sum({"D": 2, "I": 5, "R": 1, "K": 0}[e] for e in audit) + sum(5 for e, c in zip(edits, codes, strict=True) if e != "D" and 4 <= c < 8)
    assert spent == cost and 0 <= cost - C.lower_bounds(codes)[0][0] <= 10


def test_hot_conversation_copies_and_general_interface(spark):
    rows = [(1, i % 700, ("user", "assistant")[i % 2], f"Turn {i % 700}.") for i in range(2100)] + [(2, 0, "assistant", "Hello")] + [(3, None, "user", "Hi.")] * 3
    plans, repaired = C.repair(conversations(spark, rows))
    told = {r.conv_id: r for r in plans.collect()}
    assert (told[1].n_rows, told[1].duplicate, told[1].cost, told[1].gaps) == (2100, 1400, 2800, 0)
    assert [(told[c].audit, told[c].cost, told[c].duplicate) for c in (2, 3)] == [("D", 2, 0), ("DDD", 6, 2)]
    made = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.position)):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert made[1] == [(("user", "assistant")[i % 2], f"Turn {i}.") for i in range(700)] and 2 not in made
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    again, _ = C.repair(conversations(spark, shuffled))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in told.values()}


def test_empty_table(spark):
    assert C.damage_and_repair(conversations(spark, [])).collect() == []


@pytest.mark.parametrize("codes, want", [([], (0, "")), ([C.SYSTEM], (2, "D")), ([C.USER, C.USER], (1, "KR")), ([C.ASSISTANT, C.USER], (2, "RR"))])
def test_small_cases(codes, want):
    assert C.search(codes) == want
