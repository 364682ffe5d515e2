import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from scoreloom.llm import conversation_repair as cr
from scoreloom.llm.queries import PLANS

FULL = re.compile("[^\x20\x09-\x0d]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spoil(rows):
    """The damage of the contract, row by row."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def marks(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not FULL.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif FULL.findall(text)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Dijkstra over (place, state) by (cost, audit); every role string is tried against the pattern's states."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], kept + (f"{role}:",)))
        if i == len(rows):
            continue
        _, own, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 3 if faults[i] == "truncated" else 0
        if (state, own[:1]) in step:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, own[:1], kept + (f"{own}:{text}",)))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, role[0], kept + (f"{role}:{text}",)))


def brute(spoilt):
    out = {}
    for conv, rows in spoilt.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults = marks(rows)
        cost, audit, kept = cheapest(rows, faults)
        turns = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def run(spark, rows, spoilt=True, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        for name in ("Copies", "digest", "look", "kind", "class", "audit", "place"):
            df = df.withColumn(name, cr.F.lit(1))
    report, prepared = cr.repair(cr.damage(df) if spoilt else df.select("conv_id", "turn", "role", "text"), "copies" if spoilt else None)
    return found(cr.repaired_digests(prepared, report)), report, prepared


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why?", "a long answer that stops", "Well!\t", "…", "x. y"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [
        (conv, None if rng.random() < 0.05 else rng.randrange(2 * longest), rng.choice(roles), rng.choice([*texts, None, f"{conv} {i}."]))
        for conv in [None, *range(conversations)] for i in range(rng.randrange(longest))]


@pytest.mark.parametrize("seed,conversations,longest", [(1, 300, 7), (2, 60, 25), (3, 4, 120)])
def test_brute_force(spark, seed, conversations, longest):
    rows = random_rows(seed, conversations, longest)
    assert run(spark, rows, extra=True)[0] == brute(spoil(rows))


def test_query_on_the_test_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(PLANS["op12_conversation_repair"](spark, sf)) == brute(spoil(rows))


def test_long_runs_cross_blocks_and_pieces(spark):
    """One conversation of thousands of equal faults, and one whose symbols change at every row."""
    rows = [(1, t, "user", f"q {t}.") for t in range(3000)]
    rows += [(2, t, ("user", "assistant", "assistant")[t % 3], f"{t}" + "." * (t % 5 > 0)) for t in range(2500)]
    rows += [(3, t, "user", "same.") for t in range(2600)]
    assert run(spark, rows, spoilt=False)[0] == brute({c: [r[1:] for r in rows if r[0] == c] for c in (1, 2, 3)})


def test_powers_equal_single_steps():
    steps = cr.Steps(cr.Costs())
    for sym in range(9):
        slow = fast = steps.end
        for n in range(1, 40):
            slow = cr.advance(steps.power(sym, 0), slow)
            assert steps.run(sym, n, fast) == slow


def test_repaired_rows_are_the_digested_ones(spark):
    rows = random_rows(5, 80, 9)
    got, report, prepared = run(spark, rows)
    parts = defaultdict(list)
    for r in cr.repaired_rows(prepared, report).orderBy("place").collect():
        assert len(parts[r["conv_id"]]) == r["place"]
        parts[r["conv_id"]].append(r)
    for conv, values in got.items():
        kept = parts[conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))
        assert "".join(r["edit"] for r in kept) == values[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == values[7]


def test_edges(spark):
    assert run(spark, [])[0] == {}
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hm.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long_text = "word " * 400_000 + "."
    rows = [(7, 0, "user", long_text), (7, 1, "assistant", long_text), (7, 9, "assistant", long_text)] * 2
    assert run(spark, rows, spoilt=False)[0] == brute({7: [r[1:] for r in rows]})
