"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orbitframe.llm import conversation_repair as repair
from orbitframe.llm import runtime

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            out[conv] += []
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c, v in out.items()}


def by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest): the edits by a search in order of (cost, letters)."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            break
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in STEPS:
                heapq.heappush(heap, (cost + 3, letters + "I", i, STEPS[state, role[0]], (*kept, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, kept))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] != "")
                if (state, role[:1]) in STEPS:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, STEPS[state, role[:1]], (*kept, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (state, other[0]) in STEPS:
                        heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, STEPS[state, other[0]], (*kept, f"{other}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def check(df, **sizes):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df, **sizes).collect()}
    assert got == {c: by_hand(v) for c, v in damaged(rows).items()}
    return got


def made(rng, conv, n, roles=("user", "assistant"), odd=0.25):
    out = []
    for k in range(n):
        role = roles[k % 2] if rng.random() > odd else rng.choice(["system", "user", "assistant", "tool", "", None, "agent"])
        text = rng.choice(["Yes.", "No!", "why", "", " \n", None, f"text {rng.random()}.", "ö?  ", "same."])
        out.append((conv, k if rng.random() > 0.1 else rng.choice([None, k + 2, k - 1]), role, text))
    return out


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in made(rng, c, rng.randint(1, 12))] + made(rng, None, 5) + [(500, 0, "user", "Hi.")]
    return spark.createDataFrame(rows, SCHEMA)


def test_given_conversations(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_random_conversations(small):
    got = check(small.withColumns({c: F.lit("clash") for c in ("name", "place", "block", "mark", "n", "digest", "fault", "hit")}))
    assert {letter for r in got.values() for letter in r[6]} == set("DIKR")


@pytest.mark.parametrize("block, group", [(1, 2), (3, 2), (64, 256)])
def test_long_conversations_over_many_blocks(spark, monkeypatch, block, group):
    monkeypatch.setattr(runtime, "BROADCAST_IDS", 0)
    rng = random.Random(6)
    rows = made(rng, 1, 400, odd=0.4) + made(rng, 2, 30) + made(rng, 3, 3, odd=1) + [(4, 9, "user", "Again.")] * 150
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, group=group)


def test_nothing_left_and_no_rows(spark, small):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert [tuple(r) for r in repair.repair(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(small.limit(0)).collect() == []


def test_very_long_texts(spark):
    check(spark.createDataFrame([(k, t, "user" if t % 2 == 0 else "assistant", f"{k}{t}" + "word " * 100_000 + ".") for k in range(3) for t in range(3)], SCHEMA))


def test_auction_prices_are_dual(spark):
    """No arc costs less than its prices' difference, and the origin's price is the distance."""
    rng = random.Random(7)
    for _ in range(200):
        codes = bytes(rng.choice([repair.code_of(r, f) for r in ("s", "u", "a", "x") for f in range(4)]) for _ in range(rng.randint(1, 10)))
        arcs = [*repair.arcs_of(codes), *[[("", c, (len(codes) + 1) * 4)] for c in repair.FINAL], []]
        price = [0.0] * len(arcs)
        cost = repair.auction(arcs, 0, len(arcs) - 1, price, 4 * len(codes) + 12)
        assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for _, c, j in out)
        best = [0.0 if i == len(arcs) - 1 else 1e9 for i in range(len(arcs))]
        for _ in arcs:
            for i, out in enumerate(arcs):
                best[i] = min([best[i], *[c + best[j] for _, c, j in out]])
        assert cost == best[0] == price[0]
