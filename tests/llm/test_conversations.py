"""Conversation repair and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from homerange.llm import conversation_repair as repair
from homerange.llm import prefix_trie
from homerange.llm.queries import oracle_sql, queries
from tests.compare import check
from tests.conftest import SF_SMALL

SOUND = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, edit string, fault string, lost string, again string"


def plain_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """Cheapest edits of (role, text, fault) rows, found by walking through whole audits in
    order of (cost, audit) without any notion of survivors."""
    fits = re.compile(r"(s?(ua)*u?)?|s")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and SOUND.fullmatch(initials):
            return cost, audit, list(lines)
        for initial, role in (("u", "user"), ("a", "assistant")):
            if fits.fullmatch(initials + initial) and audit[-3:] != "III":
                heapq.heappush(heap, (cost + 5, audit + "I", i, initials + initial, (*lines, role + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                extra = cost + 5 * (fault == "truncated")
                for initial, name, price, e in ((role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")):
                    if initial and fits.fullmatch(initials + initial):
                        heapq.heappush(heap, (extra + price, audit + e, i + 1, initials + initial, (*lines, f"{name}:{text}")))
    raise AssertionError


def plain_report(rows: list[tuple]) -> tuple:
    """Report of one conversation's (turn, role, text) rows."""
    white = " \t\n\x0b\x0c\r"
    fix = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    fix.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    for _, role, text in fix:
        left = text.strip(white)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "" if left[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = {t for t, _, _ in fix if t is not None}
    cost, audit, lines = plain_repair(judged)
    kinds = [f for _, _, f in judged]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(seed: int, n: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ünter", "User"]
    texts = ["Hi.", "What? ", "no end", " \n", "", None, "Fine!\x0b", " ", "Ok."]
    for c in range(n):
        for _ in range(rng.randrange(1, 8)):
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            out.append((c, turn, rng.choice(roles), rng.choice(texts), "x", "x", "x", "x"))
    out.append((None, 4, "user", "No id.", "x", "x", "x", "x"))
    return out + out[:5]


def test_reports_match_plain_search(spark):
    data = conversations(5, 250)
    held = defaultdict(list)
    for c, *row in data:
        held[c].append(tuple(row[:3]))
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(spark.createDataFrame(data, TURNS)).collect()}
    assert got == {c: plain_report(rows) for c, rows in held.items()}


def test_repaired_rows_are_the_reported_ones(spark):
    turns = spark.createDataFrame(conversations(6, 60), TURNS)
    lines = defaultdict(list)
    for r in repair.repaired(turns).orderBy("conv_id", "position").collect():
        lines[r.conv_id].append((r.edit, r.role, r.text))
    for r in repair.report(turns).collect():
        mine = lines[r.conv_id]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(e for e, _, _ in mine) == r.audit.replace("D", "")
        assert SOUND.fullmatch("".join(a[:1] for _, a, _ in mine))


def test_long_conversation_keeps_few_nodes():
    rng, kinds = random.Random(1), []
    search = repair.Repair(lambda edit, initial, row: kinds.append(edit))
    most = 0
    for i in range(60_000):
        search.step(rng.choice("uuaas"), rng.random() < 0.1, rng.random() < 0.1, ("user", str(i)))
        nodes, todo = 0, [search.root]
        if i % 500 == 0:
            while todo:
                node = todo.pop()
                nodes += 1
                todo += node.kids
            most = max(most, nodes)
    assert search.finish() > 0 and len(kinds) >= 60_000
    assert most < 200


def test_unresolved_ties_stay_whole():
    """Rows that leave two ways open until the end: nothing is certain before it."""
    for n in (2, 3, 8, 9):
        rows = [("user", f"{i}.", "") for i in range(n)]
        out = []
        search = repair.Repair(lambda edit, initial, row, out=out: out.append(edit))
        for role, text, _ in rows:
            search.step(role[0], False, False, (role, text))
        assert (search.finish(), "".join(out)) == plain_repair(rows)[:2]


def test_damage_and_empty(spark):
    data = [(c, t, "user", "A. B! C?", "", "", "", "") for c in range(40) for t in (None, *range(6))] + [(None, None, None, None, "", "", "", "")]
    damaged = repair.damage(spark.createDataFrame(data, TURNS)).collect()
    want = []
    for c, t, role, text, *_ in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)
        want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, damaged))) == sorted(map(str, want))
    none = spark.createDataFrame([], TURNS)
    assert repair.report(none).count() == repair.repaired(none).count() == 0
    lost = repair.report(spark.createDataFrame(data[:7], TURNS), lost=repair.F.lit(True)).collect()
    assert [tuple(r) for r in lost] == [(0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("name", ["op7_quality_rules", "op11_conversation_repair", "op13_prefix_trie"])
def test_matches_duckdb(spark, duck_small, name):
    ok, msg = check(spark, SF_SMALL, name, queries()[name], oracle_sql()[name], duck_small)
    assert ok, msg


def plain_trie(built: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        parts = [below(k) for k in kids[p]]
        return (sum(x for x, _ in parts) or (0 if parts else 1)), own + sum(y for _, y in parts)

    out = set()
    for p, who in members.items():
        leaves, saved = below(p)
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.add((who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(kids[p]), leaves, saved, sha))
    return out


def plain_rebuilt(turns: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, t, r, x, *_ in turns:
        if c is not None:
            key = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()
            own[c].append((t is not None, t or 0, key, (r or "", x or "")))
    own = {c: [r[3] for r in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        out[c] = base[:h] + s[h:]
    return out


@pytest.mark.parametrize("block_turns", [1_000_000, 40, 3])
def test_trie_matches_plain_version(spark, block_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rng, data = random.Random(3), []
    for c in range(-6, 90):
        if c % 11 == 3:
            continue
        copy = c % 3 == 0  # a third are copies
        for t in range(12 if copy else rng.randrange(1, 14)):
            role = "user" if copy or t % 2 == 0 else rng.choice(["assistant", None, ""])
            text = "same" if copy else rng.choice(["a", "b", None, "", "é日"])
            data.append((c, t if t else None, role, text, "x", "x", "x", "x"))
    data += [(None, 1, "user", "left out", "", "", "", "")] + data[:4]
    turns = spark.createDataFrame(data, TURNS)
    built = prefix_trie.rebuilt(prefix_trie.sequences(turns))
    want = plain_rebuilt(data)
    assert {r.conv_id: len(r.steps) for r in built.collect()} == {c: len(s) for c, s in want.items()}
    assert any(not s for s in want.values())
    got = [tuple(r) for r in prefix_trie.trie(built, block_turns=block_turns).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(want)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.sequences(none)).count() == 0
    one = spark.createDataFrame([(7, 0, None, None, "", "", "", "")], TURNS)
    alone = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(one))).collect()]
    assert set(alone) == plain_trie(plain_rebuilt([(7, 0, None, None)]))
