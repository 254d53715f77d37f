"""Conversation repair against a shortest-path search over single edits."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place string, audit long, n string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """``cost, audit, repaired`` of one conversation: ordered (turn, role, text) rows."""
    kinds, seen = [], set()
    for _, role, text in rows:
        said = text.strip(BLANK)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, said = heapq.heappop(queue)
        if (i, last) in done:
            continue
        if i == len(rows) + 1:
            return cost, audit, said, kinds
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            heapq.heappush(queue, (cost, audit, i + 1, "end", said))
        for role in ("user", "assistant"):
            if (last, role[0]) in follow:
                heapq.heappush(queue, (cost + 3, audit + "I", i, role[0], (*said, f"{role}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, said))
        if kinds[i] in ("blank", "duplicate"):
            continue
        more = 3 * (kinds[i] == "truncated")
        if (last, role[:1]) in follow:
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if (last, other[0]) in follow:
                heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, other[0], (*said, f"{other}:{text}")))


def expected(rows):
    found = {}
    talks = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        cost, audit, said, kinds = cheapest(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        found[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return found


def got(rows, spark):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repair.report(repair.repair(frame)).collect()}


def random_talk(conv, n, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "User", "usher", None]
    texts = ["Yes.", "No!", "", " \n", "cut", "cut off", "ok? ", None, "Zwölf 𝔘.", "a\nb."]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [
        (conv, draw.choice([i, i, i, i + 1, None]) if draw.random() < 0.3 else i, draw.choices(roles, weights)[0], draw.choice(texts) if draw.random() < 0.4 else f"text {i}{draw.choice('.!?x')}")
        for i in range(n)
    ]


def test_random_conversations(spark):
    rows = [r for c in range(60) for r in random_talk(c, c % 13, c)]
    rows += [r for c in range(60, 70) for r in random_talk(None if c == 69 else c, 9, c)] + rows[:9] * 3
    assert got(rows, spark) == expected(rows)


def test_a_conversation_over_many_segments_and_tasks(spark):
    rows = random_talk(1, 5000, 5) + random_talk(2, 3, 6) + [(3, 7, "user", "same text")] * 4000
    found, want = got(rows, spark), expected(rows)
    assert {c: v[:6] for c, v in found.items()} == {c: v[:6] for c, v in want.items()}
    assert found == want


def test_grammar_is_learnt_and_lossless(spark):
    sequences = ["uaua" * 50, "suaua" * 20, "ua" * 7, "uadDua", "s"]
    frame = spark.createDataFrame([(s,) for s in sequences], "symbols string")
    grammar = repair.learn_grammar(frame)
    assert 0 < len(grammar.rules) <= repair.RULES

    def expand(symbol):
        return symbol if ord(symbol) < repair.FIRST_RULE else "".join(map(expand, grammar.rules[ord(symbol) - repair.FIRST_RULE]))

    for s in sequences:
        short = grammar.compress(s)
        assert "".join(map(expand, short)) == s
        assert len(short) <= max(4, len(s) // 5)


def test_pieces_hold_the_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "")]
    frame = spark.createDataFrame([(*r, "", "", 1, "") for r in rows], SCHEMA)
    piece = repair.repair(frame).select("audit", F.explode("repaired").alias("t")).collect()
    assert [(r["audit"], r["t"]["role"], r["t"]["text"]) for r in piece] == [
        ("KIKD", "system", "Be kind."), ("KIKD", "user", ""), ("KIKD", "assistant", "Hello.")]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(5, 1, "", "")]])
def test_odd_tables(rows, spark):
    assert got(rows, spark) == expected(rows)
