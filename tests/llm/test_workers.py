"""Python workers and memory of one task."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from cohortpulse.llm import exact_dedup, language_id
from cohortpulse.llm.common import pieces, text_pieces
from tests.helpers import first_plan

ROWS = [(1, "one text", "en", "a"), (2, "one  text", "en", "a"), (3, None, None, None), (None, "other", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


def most_python_nodes(df) -> int:
    """Python nodes of one stage at most, for a plan without joins."""
    plan = first_plan(df)
    stages = re.split(r"Exchange|Scan parquet", plan)
    return max(len(re.findall(r"MapInPandas|MapInArrow|ArrowEvalPython", s)) for s in stages)


def test_exact_dedup_has_one_worker_a_task(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(20)
    rows = exact_dedup.measured(docs)
    for fan_in in (2, 8, 64):  # several rounds and one
        found = exact_dedup.groups(rows, fan_in)
        assert most_python_nodes(found) == 1
        kept = {(r["keep_id"], r["group_size"]) for r in found.collect()}
        assert kept == {(2, 2), (3, 1), (None, 1)}




def test_text_pieces_count_characters():
    texts = ["", None, "äöü", "x" * 10, "€", "yy", None]
    for most in (1, 2, 3, 4, 11, 100):
        lengths = np.array([len(t) if t else 0 for t in texts])
        assert text_pieces(pa.array(texts, pa.string()), most) == pieces(lengths, most)
    assert text_pieces(pa.array([], pa.string()), 5) == []


def test_verdicts_take_memory_by_piece_not_by_batch():
    model = language_id.Model(
        ["de", "en"],
        np.zeros((language_id.BUCKETS, 2), np.float32),
        np.ones((language_id.SCRIPTS, 2), bool),
    )
    text = " ".join(f"word{chr(97 + i % 26)}" for i in range(300))

    def peak(n: int) -> int:
        texts = pa.array([text, None, "123"] * n, pa.string())
        tracemalloc.start()
        verdicts = language_id._verdicts(texts, model)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert verdicts == [True, False, False] * n
        return most

    assert peak(6_000) < 1.15 * peak(1_200)


def test_verdicts_without_a_model(spark):
    docs = spark.createDataFrame(ROWS + [(5, "12", None, "a")], SCHEMA)
    model = language_id.fit(docs.where("lang IS NULL"))
    kept = language_id.identified(docs, model).collect()
    assert sorted(r["text"] for r in kept) == ["one  text", "one text", "other"]
