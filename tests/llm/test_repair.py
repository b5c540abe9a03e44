"""Conversation repair against plain strings and against every edit there is."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from marketloom.llm import conversation_repair as repair

SEEN = re.compile("[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, audit int"
COST = {"D": 2, "K": 0, "R": 1, "I": 5}


def damaged_by_hand(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def step(state, initial):
    return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(initial, {}).get(state)


def better(best, state, value):
    if state is not None and (state not in best or value[:2] < best[state][:2]):
        best[state] = value


def inserted(best):
    out, todo = dict(best), [(s, v) for s, v in best.items()]
    for _ in range(3):
        todo = [(step(s, r[0]), (c + 5, a + "I", m + ((r, ""),))) for s, (c, a, m) in todo for r in ("user", "assistant") if step(s, r[0])]
        for s, v in todo:
            better(out, s, v)
    return out


def by_hand(rows, every):
    conversations, out = {c: [] for c in every}, []
    for c, t, r, x in rows:
        conversations.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for c, rs in conversations.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults, best = set(), [], {"": (0, "", ())}
        for _, r, x in rs:
            letters = SEEN.findall(x)
            faults.append("blank" if not letters else "duplicate" if (r, x) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((r, x))
        for (_, r, x), f in zip(rs, faults):
            new, stay = {}, 5 if f == "truncated" else 0
            for s, (cost, a, m) in inserted(best).items():
                better(new, s, (cost + 2, a + "D", m))
                if f not in ("blank", "duplicate"):
                    better(new, step(s, r[:1]), (cost + stay, a + "K", m + ((r, x),)))
                    for role in ("user", "assistant"):
                        better(new, step(s, role[0]), (cost + 1 + stay, a + "R", m + ((role, x),)))
            best = new
        cost, audit, m = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
        turns = [t for t, *_ in rs if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{x}" for r, x in m).encode()).hexdigest()))
    return sorted(out, key=str)


def all_edits(roles, faults):
    """The best of every edit of a conversation, each really tried."""
    best = None
    for edits in itertools.product("DKR", repeat=len(roles)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults)):
            continue
        for inserts in itertools.product((0, 1, 2), repeat=len(roles) + 1):
            audit = "".join("I" * i + e for i, e in zip(inserts, edits)) + "I" * inserts[-1]
            cost = sum(COST[e] for e in audit) + sum(5 for e, f in zip(edits, faults) if f == "truncated" and e != "D")
            if best and (cost, audit) >= best:
                continue
            kept = iter(roles)
            slots = [x for e in audit if (x := "ua" if e == "I" else ((next(kept)[:1] or "?") if e == "K" else ("ua", next(kept))[0] if e == "R" else (next(kept), "")[1]))]
            if any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*slots)):
                best = (cost, audit)
    return best


def test_against_every_edit():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randint(0, 4)
        roles = [rnd.choice(["system", "user", "assistant", "tool", ""]) for _ in range(n)]
        faults = [rnd.choice(["", "", "truncated", "blank"]) for _ in range(n)]
        run = repair.Run(1, True)
        for k in range(n):
            run.add(k, roles[k][:1], faults[k])
        got = repair.Repair.of(1, [run.record(0, 0)] if n else [])
        assert (got.cost, got.audit) == all_edits(roles, faults)


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(11), []
    texts = ["Hello there.", "hi", "Yes!", "no way?", "", "  \t", "ok.", None]
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            out.append((c, t if rnd.random() > 0.05 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice([*texts, f"text {c} {t}.", f"text {c} {t}"])))
    out += [(None, k, "user", "x.") for k in range(5)] + [(778, 5, "user", "same.")] * 40 + [(779, 1, "user", "word " * 60_000 + ".")]
    out += [(777, k // 3, rnd.choice(["user", "assistant", "system"]), f"{rnd.randint(0, 40)}{rnd.choice(['.', ''])}") for k in range(300)]
    return out + out[:30]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(6).cache()


@pytest.mark.parametrize("run", [4096, 7, 1])
def test_reports(table, rows, run):
    got = repair.report(table, run=run).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, ())


def test_damage(table, rows):
    every = {r[0] for r in rows}
    got = repair.report(repair.damage(table), table, 7).collect()
    want = by_hand(damaged_by_hand(rows), every)
    assert sorted(map(tuple, got), key=str) == want and len(want) == len(every)


def test_messages(table, rows):
    left = {}
    for r in repair.repaired(table, 9).orderBy("conv_id", "place").collect():
        assert r.place == len(left.setdefault(r.conv_id, []))
        left[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(left.get(w[0], [])).encode()).hexdigest() == w[8] for w in by_hand(rows, ()))


def test_empty_tables(table):
    none = table.filter("false")
    assert repair.report(none, none).count() == 0 and repair.repaired(none).count() == 0
    got = repair.report(none, table).collect()
    assert {(r.cost, r.audit, r.repaired_sha256) for r in got} == {(0, "", hashlib.sha256().hexdigest())}


def test_equal_hashes_of_different_prefixes_are_seen(monkeypatch):
    monkeypatch.setattr(repair, "MODULUS", 1)  # all hashes are equal
    a = b = repair.Prefix()
    for x, y in zip("KKDR", "KDKR"):
        a, b = repair.Prefix(a, x), repair.Prefix(b, y)
    assert repair.precedes(b, "K", a, "D") and not repair.precedes(a, "D", b, "K")
