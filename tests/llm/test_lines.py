"""Line dedup against brute force, and its perfect hash."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortpulse.llm import line_dedup, perfect_hash
from tests.llm.test_operators import ODD, table

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, points=20, least=3):
    """``[(id, lines, dropped, sha256)]`` in the order of the rows."""
    lower = {c: c + 32 for c in range(65, 91)}
    keys = [[line.strip(SPACES).translate(lower) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for row, own in enumerate(keys):
        for key in own:
            holders[key].add(row)
    out = []
    for row, (doc, text) in enumerate(rows):
        kept = []
        for line, key in zip((text or "").split("\n"), keys[row]):
            ids = [rows[r][0] for r in holders[key]]
            largest = max((i for i in ids if i is not None), default=None)
            if len(key) < points or len(ids) < least or doc == largest:
                kept.append(line)
        n = len(keys[row])
        out.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def found(docs):
    rows = line_dedup.deduplicated(docs).collect()
    return [(r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), unique=True, max_size=300))
def test_places_are_minimal_and_perfect(digests):
    high, low = (np.array([d[k] for d in digests], np.uint64) for k in (0, 1))
    levels = perfect_hash.from_bytes(*perfect_hash.to_bytes(perfect_hash.built(high, low)))
    places = perfect_hash.Places(levels)
    assert sorted(places.of(high, low).tolist()) == list(range(len(digests))) and places.size == len(digests)


def test_strangers_get_some_place_or_none():
    some = np.arange(2000, dtype=np.uint64)
    places = perfect_hash.Places(perfect_hash.built(some[:1000], some[:1000]))
    at = places.of(some[1000:], some[1000:])
    assert ((at >= -1) & (at < 1000)).all() and (at == -1).any()


def test_lines_of_random_documents(spark):
    draw = random.Random(7)
    lines = ["The same line of many words", "the SAME line of many words\t", " The same line of many words\r", "é" * 20,
             "É" * 20, "e" * 19, "x" * 19 + "é", "漢" * 20, "漢" * 19, "", " ", "unique to nobody at all, really", "\x0b", "ſ" * 25]
    rows = [(draw.choice([None, *range(30)]), "\n".join(draw.choices(lines, k=draw.randint(0, 6)))) for _ in range(60)]
    rows += [(100 + i, f"line number {i} is not repeated\n" + "x" * 30) for i in range(5)]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)
    assert ordered(found(docs)) == ordered(brute(rows))


def test_lines_of_odd_rows(spark):
    rows = [*ODD, (11, LONG_LINES, "en", "a"), (12, LONG_LINES, "en", "a"), (13, LONG_LINES, "en", "a"), (2**53 + 1, None, None, None)]
    assert ordered(found(table(spark, rows).repartition(3))) == ordered(brute([r[:2] for r in rows]))
    empty = table(spark, rows).limit(0)
    assert line_dedup.deduplicated(empty).count() == 0


LONG_LINES = "\n".join(f"line {i} of a very long text, told {i % 7} times" for i in range(30000))


def test_entries_are_added_up_before_they_are_sent(spark, monkeypatch):
    """A line of every document is one entry for each batch of a task, and one place in the index."""
    docs = table(spark, [(i, f"a line that all documents share\nown line of document {i}", "en", "a") for i in range(1000)])
    base, _ = line_dedup.lots(docs.coalesce(2))
    index = line_dedup.line_index(base, 4).collect()
    assert sum(r["lines"] for r in index) == 1
    row = next(r for r in index if r["lines"])
    assert np.frombuffer(row["counts"], "<i8").tolist() == [1000] and np.frombuffer(row["largest"], "<i8").tolist() == [999]
