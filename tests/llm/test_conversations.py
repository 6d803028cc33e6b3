"""Conversation repair against a search over all edits, and against DuckDB (``test_operators``)."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortpulse.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Least cost, then least edits, over ``(role, fault)`` rows: a search that only knows the edits and the grammar."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, initials = heapq.heappop(heap)
        state = (i, initials[-1:], initials == "")
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, edits
        if (state, "done") in seen:
            continue
        seen.add((state, "done"))

        def push(price, edit, j, new):
            grown = initials + new
            if re.fullmatch(r"(s?(ua)*u?)?", grown):
                heapq.heappush(heap, (cost + price, edits + edit, j, grown))

        for new in "ua":
            push(5, "I", i, new)
        if i < len(rows):
            role, fault = rows[i]
            push(2, "D", i + 1, "")
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1]:
                    push(more, "K", i + 1, role[:1])
                for new in "ua":
                    push(1 + more, "R", i + 1, new)
    raise AssertionError


def brute(table):
    """``{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}`` from ``(conv_id, turn, role, text)``."""
    text_of = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            role, text = text_of(role), text_of(text)
            if kind == 1:
                text = ""
            elif kind == 2:
                text = re.sub("[.!?]", "", text)
            elif kind == 4:
                role = "user"
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = SHOWN.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for _, r, _ in rows]
        cost, edits = cheapest([(r, f) for (_, r, _), f in zip(rows, faults)])
        kept, left = [], list(rows)
        expected = lambda: "assistant" if kept and kept[-1][0][:1] == "u" else "user"
        for e in edits:
            if e == "I":
                kept.append((expected(), ""))
                continue
            _, role, text = left.pop(0)
            if e != "D":
                kept.append((role if e == "K" else expected(), text))
        whole = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256(whole.encode()).hexdigest(),
        )
    return out


def found(frame):
    rows = conversations.repaired(frame).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    extra = "signature string, digest int, figures int, audit string, gone int, kind int, first_role string, n int"
    filled = [(*r, "x", 1, 2, "y", 3, 4, "z", 5) for r in rows]
    return spark.createDataFrame(filled, f"conv_id long, turn long, role string, text string, {extra}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaxSUAXd", max_size=9))
def test_cost_and_edits_of_a_signature(signature):
    path = [conversations._END]
    for letter in reversed(signature):
        path.append(conversations.node(letter, path[-1]))
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    rows = [(role[c.lower()], "blank" if c == "d" else "truncated" if c.isupper() else "") for c in signature]
    assert (path[-1][conversations.START][0], conversations.audit(path)) == cheapest(rows)


def test_repair_of_random_conversations(spark):
    draw = random.Random(11)
    texts = ["Fine.", "fine", "Fine.", "No end", "", " \t", "Ends with space! ", "Q?", "x ", "end. ", None, "a\nb."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uncle"]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(draw.randint(1, 9)):
            if draw.random() < 0.9:
                at = None if draw.random() < 0.05 else turn * draw.choice([1, 1, 2])
                rows.append((conv, at, draw.choice(roles), draw.choice(texts) if draw.random() < 0.7 else f"Text {turn} of {conv}."))
    rows += rows[:25]  # repeated rows
    assert found(table(spark, rows).repartition(6)) == brute(rows)


def test_repair_of_odd_tables(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)]
    rows += [(2, 0, "user", long), (2, 1, "assistant", long), (3, None, None, None), (None, None, None, None), (2**53 + 1, 5, "user", "?")]
    dropped = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = found(table(spark, rows).repartition(4))
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(table(spark, rows).limit(0)) == {}


def test_nodes_are_computed_once_for_a_shared_end(spark, monkeypatch):
    calls = []
    real = conversations.node
    monkeypatch.setattr(conversations, "node", lambda letter, rest: calls.append(letter) or real(letter, rest))
    signatures = sorted(("ua" * n for n in range(1, 40)), key=lambda s: s[::-1])
    batches = [pa.RecordBatch.from_arrays([pa.array(signatures)], names=["signature"])]
    rows = pa.Table.from_batches(list(conversations._repairs(iter(batches)))).to_pylist()
    assert len(calls) == 78 and all(r["cost"] == 0 and r["audit"] == "K" * len(r["signature"]) for r in rows)
