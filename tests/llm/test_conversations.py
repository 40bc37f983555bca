"""Conversation repair against an exhaustive search of edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from marketloom.llm import conversations
from marketloom.llm.queries import QUERIES

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    """Rows (turn, role, text) in order with their faults."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "fine" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_repair(rows):
    """From the end: cheapest (cost, audit, lines) for each last initial, whole audits compared."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    never = (10**9, "", [])
    after = {"": (0, "", []), "a": (0, "", []), "s": never, "u": never}

    def with_insertions(best):
        for _ in range(3):
            for last, allowed in follows.items():
                for new in allowed.replace("s", ""):
                    c, a, t = best[new]
                    best[last] = min(best[last], (c + 5, "I" + a, [names[new] + ":"] + t))
        return best

    after = with_insertions(after)
    for _, role, text, fault in reversed(rows):
        best = {}
        for last, allowed in follows.items():
            c, a, t = after[last]
            options = [(c + 2, "D" + a, t)]
            if fault in ("fine", "truncated"):
                for edit, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if name and name[0] in allowed:
                        c, a, t = after[name[0]]
                        options.append((c + cost + 5 * (fault == "truncated"), edit + a, [f"{name}:{text}"] + t))
            best[last] = min(options)
        after = with_insertions(best)
    return after[""]


def expected(rows):
    """By conversation, from the damaged rows (conv, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = {}
    for conv, some in by.items():
        marked = plain_faults(some)
        turns = {r[0] for r in marked} - {None}
        count = collections.Counter(r[3] for r in marked)
        initials = [r[1][:1] for r in marked]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit, lines = plain_repair(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def random_rows(rng, conv):
    roles = rng.choice([["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["user"]])
    texts = ["Yes.", "No", "", " \n", "Is it?", "well\n", "go! "]
    return [(conv, t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(0, 9))]


def result(fixed):
    digests = {r[0]: r[1] for r in conversations.digests(fixed.turns).collect()}
    return {tuple(r)[0]: (*tuple(r)[1:], digests.get(r[0], EMPTY[-1])) for r in fixed.conversations.collect()}


def test_random_conversations(spark):
    rng = random.Random(2)
    rows = [r for c in range(600) for r in random_rows(rng, c)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert result(conversations.repair(df)) == expected(rows)


def test_conversations_across_partitions(spark):
    """One conversation holds most rows, over several partitions."""
    rng = random.Random(4)
    hot = [(None, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", "a b", f"n{t}.", ""])) for t in range(400)]
    rows = hot + [r for c in range(40) for r in random_rows(rng, c)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fixed = conversations.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
        assert result(fixed) == expected(rows)
        left = [r for r in fixed.turns.collect() if r.conv_id is None]
        assert sorted(r["at"] for r in left) == list(range(len(left)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (1, 7, "tool", "x" * 300_000),
        (2, 5, "assistant", "late."), (2, 9, "system", "s."), (2, -3, "unknown", "keeps its name."), (2, 2**40, "asker", "so."),
        (3, 0, "", ""), (4, 0, "user", "same."), (4, 0, "user", "same."), (4, 0, "assistant", "same."), (4, 1, "User", "Up."),
        (5, None, "user", "dots…"), (5, None, "assistant", "é."), *[(6, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(60)],
    ]
    df = spark.createDataFrame([(*r, "y", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, letter string, place int")
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(conversations.repair(df)) == expected(filled)
    assert conversations.repair(df.limit(0)).conversations.count() == 0
    assert conversations.repair(df.limit(0)).turns.count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: EMPTY for c, *_ in rows} | expected(plain_damage(rows))


def test_query_equals_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == {c: EMPTY for c, *_ in rows} | expected(plain_damage(rows))
    assert any(r[5] for r in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_nodes_are_shared(seed):
    rng = random.Random(seed)
    found = sorted({"".join(rng.choice("AEBI") for _ in range(rng.randint(0, 12))) for _ in range(300)}, key=lambda s: s[::-1])
    suffixes = conversations.Suffixes()
    for s in found:
        alone = conversations.Suffixes().nodes_of(s)
        assert suffixes.nodes_of(s) == alone
    assert suffixes.made == len({s[i:] for s in found for i in range(len(s))})
