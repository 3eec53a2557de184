"""The trie of prefixes and the repair of turns, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barloom.llm.prefixtrie import conversation_trie
from barloom.llm.turnrepair import _STEPS, audit_conversations, cheapest_edits, damaged, repair_turns

SCHEMA = "conv_id long, turn long, role string, text string, depth long, h long, part string, node long"


def made(seed, convs, hot=0, longest=7):
    """Random conversations that share many turns; a third of them may be the same."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), convs):
        n = rng.randint(1, longest)
        same = rng.random() < hot
        for t in range(n if not same else 4):
            role = ("user", "assistant")[t % 2] if same or rng.random() < 0.8 else rng.choice(["system", "tool", None])
            text = f"turn {t}." if same or rng.random() < 0.7 else rng.choice([None, "", "cut off", "What?", " \t", f"own {c}!"])
            rows.append((c, t, role, text, 1, 2, "x", 3))
    rng.shuffle(rows)
    return rows


def trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((-1 if t is None else t, (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(path)))
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids[path], sum(kids[p] == 0 for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "convs", "hot", "longest", "task_turns"), [(1, 120, 0.35, 7, 1 << 16), (2, 90, 0.35, 7, 1), (3, 60, 0, 40, 20), (4, 1, 0, 60, 3)])
def test_trie_against_brute_force(spark, seed, convs, hot, longest, task_turns):
    rows = made(seed, convs, hot, longest)
    out = conversation_trie(spark.createDataFrame(rows, SCHEMA), task_turns).collect()
    assert sorted(map(tuple, out), key=repr) == trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(7, None, "user", "first", 0, 0, "", 0), (7, 0, None, None, 0, 0, "", 0), (None, 0, "user", "nobody", 0, 0, "", 0), (105, 0, "user", "x" * 50_000, 0, 0, "", 0), (300, 1, "user", "a", 0, 0, "", 0), (300, 1, "user", "a", 0, 0, "", 0)]
    out = conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, out), key=repr) == trie(rows)
    assert conversation_trie(spark.createDataFrame(rows[:0], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame(rows[2:3], SCHEMA)).collect() == []


def whole_table(kinds):
    """All states row by row, with their audits written out."""
    best = {0: (0, "")}
    for k in kinds:
        new = {}
        for a, b, cost, letters in _STEPS[k]:
            if a in best:
                found = (best[a][0] + cost, best[a][1] + letters)
                new[b] = min(new.get(b, found), found)
        best = new
    ends = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    return min((best[s][0] + ends[s][0], best[s][1] + ends[s][1]) for s in best)


def every_repair(kinds):
    """Cost and audit of every repair of a few rows, without the tables of the module."""
    roles = ["sua-"[k // 3] for k in kinds]
    found = []

    def walk(i, out, cost, audit, inserted):
        if len(out) > len(kinds) + 4:
            return
        if i == len(kinds):
            rest = out[1:] if out[:1] == "s" else out
            if not out or (rest and rest == "ua" * (len(rest) // 2)):
                found.append((cost, audit))
        else:
            walk(i + 1, out, cost + 3, audit + "D", 0)
            if kinds[i] % 3 != 2:
                more = kinds[i] % 3
                if roles[i] != "-":
                    walk(i + 1, out + roles[i], cost + more, audit + "K", 0)
                for r in "ua":
                    walk(i + 1, out + r, cost + 2 + more, audit + "R", 0)
        if inserted < 2:
            for r in "ua":
                walk(i, out + r, cost + 2, audit + "I", inserted + 1)

    walk(0, "", 0, "", 0)
    return min(found)


def test_divide_and_conquer_is_the_whole_search():
    rng = random.Random(5)
    for _ in range(3000):
        kinds = bytes(rng.choices(range(12), [2, 1, 1, 6, 1, 1, 6, 1, 1, 2, 1, 1], k=rng.randint(0, 40)))
        assert cheapest_edits(kinds) == whole_table(kinds)
    for _ in range(60):
        kinds = bytes(rng.choices(range(12), k=rng.randint(0, 4)))
        assert cheapest_edits(kinds) == every_repair(kinds)
    assert cheapest_edits(b"") == (0, "")


def repaired(rows):
    """The contract's columns for rows after damage, by plain loops."""
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        hurt = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[c] += []
        if hurt == 0:
            continue
        if hurt == 1:
            text = ""
        if hurt == 2:
            text = "".join(x for x in text if x not in ".!?")
        if hurt == 4:
            role = "user"
        convs[c] += [(-1 if t is None else t, role, text)] * (2 if hurt == 3 else 1)
    out = {}
    for c, held in convs.items():
        held.sort(key=lambda r: r[0])
        seen, kinds, counts, illegal = set(), [], [0, 0, 0], 0
        for i, (_, role, text) in enumerate(held):
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            kinds.append("sua".find(role[:1]) * 3 + (0, 2, 2, 1)[fault] if role[:1] and role[0] in "sua" else 9 + (0, 2, 2, 1)[fault])
            illegal += i > 0 and held[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in held if t >= 0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = whole_table(bytes(kinds))
        state, lines, rest = 0, [], iter(held)
        for letter in audit:
            if letter == "D":
                next(rest)
                continue
            fresh = "assistant" if state == 2 else "user"
            role, text = (fresh, "") if letter == "I" else next(rest)[1:]
            role = fresh if letter == "R" else role
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "longest"), [(11, 7), (12, 60)])
def test_repair_against_brute_force(spark, seed, longest):
    rows = made(seed, 80, 0.2, longest)
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = audit_conversations(conversations, damaged(conversations)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == repaired(rows) and len(out) == 80


def test_repair_of_odd_rows(spark):
    rows = [(None, 0, "user", "nobody's.", 0, 0, "", 0), (None, 1, "assistant", None, 0, 0, "", 0), (3, None, "system", "Be brief.", 0, 0, "", 0), (3, 0, None, "x" * 60_000, 0, 0, "", 0), (3, 1, "", "", 0, 0, "", 0), (3, 2, "user", "So?", 0, 0, "", 0), (3, 2, "user", "So?", 0, 0, "", 0)]
    conversations = spark.createDataFrame(rows, SCHEMA)
    out = audit_conversations(conversations, damaged(conversations)).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == repaired(rows)
    turns = repair_turns(conversations).where("conv_id = 3").orderBy("place").collect()
    roles = "".join(r["role"][0] for r in turns)
    assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and [r["place"] for r in turns] == list(range(len(turns)))
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_conversations(empty, damaged(empty)).collect() == [] and repair_turns(empty).collect() == []
