"""Conversation structure repair with a suffix-shared automaton.

The rows of a conversation, in order, are a signature: one letter a row for what the row's role and first fault allow. What
the cheapest repair of the rest of a conversation costs depends on that rest and on the state of the grammar only. Different
signatures are therefore sorted by their ends: neighbours share the longest ends, so one pass meets every node of the
automaton that reads them from the end once, keeps the path to the present one, and computes cost-to-go and the best next
edit of each node and grammar state once for all conversations. Ranges of the sorted signatures are dealt to tasks.

Faults are found by digests: a text met before in its conversation is one with an earlier first turn. Signatures need no
text; texts move once, to be joined in order and hashed as they stream by. A conversation that holds much of the table is
streamed by one task, a batch at a time; the task keeps one letter for each of its rows, as the audit does.

A repair gives role initials of ``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 1, Delete 2 and is required for
blank and duplicate rows, Insert of an empty user or assistant row 5; a truncated row that stays costs 5 more. Among the
cheapest repairs the one whose edits read least in ASCII is taken: at every node the edits of a state differ in their
letter, so the least letter decides.

Cases: null roles, texts and turns count as one space in keys and texts, so a null text is blank and a null role can only
be reroled or deleted; null turns come first; rows of one turn are ordered by role and digest of the
text, and equal ones (ties, repeated
rows) are duplicates of each other; an empty role has no initial and cannot be kept; null ``conv_id`` is one conversation;
conversations without rows after the damage have zeros, an empty audit and the hash of nothing; a very long text is hashed
as it is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import SPACES, shuffle_partitions
from cohortpulse.sources.scratch import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: Grammar states: nothing yet, after s, after u, after a. A state expects one role, at the start also s.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
#: Letters of a signature: the kept initial, in capitals where the row is truncated; other roles; rows that must go.
OTHER, GONE = "x", "d"

_SHOWN = r"[^\x20\x09-\x0D]"


def spaced(column: str) -> Column:
    """The column as text, one space for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage; a dropped row stays as a mark that its conversation exists."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: digest, what the row shows alone, and ``earlier``, whether its text has an earlier turn.

    Texts that a conversation holds once pass by; the others are joined by an equi-join that adaptive execution splits.
    """
    narrow = rows.select(
        "conv_id", "turn", "role", "gone", _digest(),
        (~F.col("text").rlike(_SHOWN)).alias("blank"),
        (~F.translate("text", SPACES, "").rlike(r"[.!?]\z")).alias("open"),
    )  # fmt: skip
    key = ["conv_id", "role", "digest"]
    repeated = (
        narrow.where(~F.col("gone"))
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("first_turn"))
        .where("n > 1")
        .select(*[F.col(c).alias(f"first_{c}") for c in key], "first_turn", F.lit(True).alias("repeated"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in key]
    earlier = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return narrow.join(repeated, same, "left").select(*narrow.columns, earlier.alias("earlier"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _streamed(rows: DataFrame, *before: str) -> DataFrame:
    """All rows of a conversation one after another, in order."""
    order = [*before, F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SIGNED = "conv_id long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", signature string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of a conversation after some of its rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = None
        self.letters = bytearray()

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, open_: bool, earlier: bool) -> None:
        repeated = earlier or self.last == (turn, role, digest)
        if self.last is not None and self.last[1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last = turn, role, digest
        letter = role[:1] if role[:1] in AFTER else OTHER
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            letter = GONE
        elif open_:
            self.truncated += 1
            letter = letter.upper()
        self.letters += letter.encode()

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The figures and the signature of each conversation, from its rows in order."""
    kinds = [pa.int64()] * (1 + len(_FIGURES)) + [pa.string()]
    names = ["conv_id", *_FIGURES, "signature"]
    held, done = None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    columns = ("conv_id", "gone", "turn", "role", "digest", "blank", "open", "earlier")
    for batch in batches:
        for conv_id, gone, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    done.append(held.row())
                held = _Conversation(conv_id)
            if not gone:
                held.add(*row)
        if len(done) >= 4096:
            yield rows()
            done = []
    if held is not None:
        done.append(held.row())
        yield rows()


Choice = tuple[int, str, int]
#: Cost-to-go, letter of the best edit and the state after it, for each grammar state where no row is left.
_END: list[Choice] = [(0, "", START), (2 * COST[INSERT], INSERT, USER), (COST[INSERT], INSERT, ASSISTANT), (0, "", ASSISTANT)]


def node(letter: str, rest: list[Choice]) -> list[Choice]:
    """The best edit in each grammar state at a row of this letter, before the node ``rest``.

    All edits but an insert go on to ``rest``; an insert stays at this node in another state.
    """
    stays = TRUNCATED if letter.isupper() else 0
    kept = AFTER.get(letter.lower())
    out = []
    for state in range(4):
        role = EXPECTED[state]
        found = [(COST[DELETE] + rest[state][0], DELETE, state)]
        if letter != GONE:
            to = AFTER[role]
            found.append((COST[REROLE] + stays + rest[to][0], REROLE, to))
            if kept is not None and (kept == to or (kept, state) == (SYSTEM, START)):
                found.append((COST[KEEP] + stays + rest[kept][0], KEEP, kept))
        out.append(min(found))
    for _ in range(3):  # a chain of inserts passes through each state once at most
        out = [min(best, (COST[INSERT] + out[AFTER[EXPECTED[s]]][0], INSERT, AFTER[EXPECTED[s]])) for s, best in enumerate(out)]
    return out


def audit(path: list[list[Choice]]) -> str:
    """The edits from the last node of ``path`` on, from the start of the grammar."""
    letters, state, at = [], START, len(path) - 1
    while True:
        _, letter, after = path[at][state]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        state = after
        at -= letter != INSERT and at > 0


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and edits of signatures that arrive sorted by their ends.

    ``path`` holds the nodes from the end of the present signature to its start. The next signature keeps those of the end
    that it shares; no later one needs the others.
    """
    path, read = [_END], ""
    for batch in batches:
        signatures, costs, audits = batch.column("signature").to_pylist(), [], []
        for signature in signatures:
            backwards = signature[::-1]
            shared, most = 0, min(len(read), len(backwards))
            while shared < most and read[shared] == backwards[shared]:
                shared += 1
            del path[shared + 1 :]
            for letter in backwards[shared:]:
                path.append(node(letter, path[-1]))
            read = backwards
            costs.append(path[-1][START][0])
            audits.append(audit(path))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
            names=["signature", "cost", "audit"],
        )


def repairs(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every different ``signature``."""
    ends = F.reverse("signature")
    different = signatures.select("signature").distinct().withColumn("ends", ends)
    dealt = different.repartitionByRange(shuffle_partitions(signatures.sparkSession), "ends").sortWithinPartitions("ends")
    return dealt.select("signature").mapInArrow(_repairs, "signature string, cost long, audit string")


class _Repair:
    """Applies the edits of an audit to rows in order and hashes what comes out, joined by newlines."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START
        self.hash, self.started = hashlib.sha256(), False

    def _out(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.started}{role}:{text}".encode())
        self.started = True

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == INSERT:
            role = EXPECTED[self.state]
            self._out(ROLE[role], "")
            self.state = AFTER[role]
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == DELETE:
            return
        initial = role[:1] if edit == KEEP else EXPECTED[self.state]
        self._out(role if edit == KEEP else ROLE[initial], text)
        self.state = AFTER[initial]

    def hexdigest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


_REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in (*_FIGURES, "cost")) + ", audit string, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of each conversation with the hash of its repaired text; its figures come before its rows."""
    kinds = [pa.int64()] * (2 + len(_FIGURES)) + [pa.string()] * 2
    names = ["conv_id", *_FIGURES, "cost", "audit", "repaired_sha256"]
    held, repair, done = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    for batch in batches:
        figures = batch.column("figures").to_pylist()
        for told, role, text in zip(figures, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            if told is None:
                repair.add(role, text)
                continue
            if held is not None:
                done.append((*held.values(), repair.hexdigest()))
            held, repair = told, _Repair(told["audit"])
        if len(done) >= 4096:
            yield rows()
            done = []
    if held is not None:
        done.append((*held.values(), repair.hexdigest()))
        yield rows()


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the figures of its damage, the cost and edits of its repair, the hash of the outcome."""
    rows = damaged(conversations)
    signed = written(_streamed(marked(rows)).mapInArrow(_signatures, _SIGNED), "conversation-signatures")
    told = signed.join(repairs(signed), "signature")
    figures = F.struct("conv_id", *_FIGURES, "cost", "audit").alias("figures")
    none = F.lit(None).cast("string")
    first = told.select(
        "conv_id", figures, F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"),
        F.lit(None).cast("binary").alias("digest"),
    )  # fmt: skip
    texts = rows.where(~F.col("gone")).select(
        "conv_id", F.lit(None).cast(first.schema["figures"].dataType).alias("figures"), "turn", "role", "text", _digest()
    )
    both = _streamed(first.unionByName(texts), F.col("figures").isNull())
    return both.select("figures", "role", "text").mapInArrow(_hashed, _REPAIRED)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda c: [(ord(c) & 15)::BIGINT, (ord(c) >> 4)::BIGINT]))),
      lambda crc, half: xor(crc >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[
        (xor(crc, half) & 15) + 1])) AS crc
  FROM conversations
), kinds AS (
  SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS c(copy)
), placed AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[ 	-]', '', 'g') AS shown,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place
  FROM rows
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
), faults AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(shown, '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault
  FROM seen
), letters AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial NOT IN ('s', 'u', 'a') THEN 'x' ELSE initial END AS l
  FROM faults
), signed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(CASE WHEN fault = 'truncated' THEN upper(l) ELSE l END, '' ORDER BY place) AS signature
  FROM letters GROUP BY conv_id
), steps AS (
  SELECT DISTINCT signature, 0 AS k, {'c': 0, 'e': ''} AS n0, {'c': 10, 'e': 'II'} AS n1, {'c': 5, 'e': 'I'} AS n2,
    {'c': 0, 'e': ''} AS n3
  FROM signed
  UNION ALL
  SELECT signature, k, b0, b1, b2, b3 FROM (
    SELECT signature, k, least(m0, {'c': m2.c + 5, 'e': 'I' || m2.e}) AS b0,
      least(m1, {'c': m2.c + 5, 'e': 'I' || m2.e}) AS b1, least(m2, {'c': m3.c + 5, 'e': 'I' || m3.e}) AS b2,
      least(m3, {'c': m2.c + 5, 'e': 'I' || m2.e}) AS b3
    FROM (
      SELECT signature, k,
        least({'c': n0.c + 2, 'e': 'D' || n0.e},
          CASE WHEN l <> 'd' THEN {'c': n2.c + 1 + t, 'e': 'R' || n2.e} ELSE {'c': 999999999, 'e': ''} END,
          CASE l WHEN 's' THEN {'c': n1.c + t, 'e': 'K' || n1.e} WHEN 'u' THEN {'c': n2.c + t, 'e': 'K' || n2.e}
            ELSE {'c': 999999999, 'e': ''} END) AS m0,
        least({'c': n1.c + 2, 'e': 'D' || n1.e},
          CASE WHEN l <> 'd' THEN {'c': n2.c + 1 + t, 'e': 'R' || n2.e} ELSE {'c': 999999999, 'e': ''} END,
          CASE l WHEN 'u' THEN {'c': n2.c + t, 'e': 'K' || n2.e} ELSE {'c': 999999999, 'e': ''} END) AS m1,
        least({'c': n2.c + 2, 'e': 'D' || n2.e},
          CASE WHEN l <> 'd' THEN {'c': n3.c + 1 + t, 'e': 'R' || n3.e} ELSE {'c': 999999999, 'e': ''} END,
          CASE l WHEN 'a' THEN {'c': n3.c + t, 'e': 'K' || n3.e} ELSE {'c': 999999999, 'e': ''} END) AS m2,
        least({'c': n3.c + 2, 'e': 'D' || n3.e},
          CASE WHEN l <> 'd' THEN {'c': n2.c + 1 + t, 'e': 'R' || n2.e} ELSE {'c': 999999999, 'e': ''} END,
          CASE l WHEN 'u' THEN {'c': n2.c + t, 'e': 'K' || n2.e} ELSE {'c': 999999999, 'e': ''} END) AS m3
      FROM (
        SELECT signature, k + 1 AS k, n0, n1, n2, n3, lower(substr(signature, length(signature) - k, 1)) AS l,
          CASE WHEN substr(signature, length(signature) - k, 1) BETWEEN 'A' AND 'Z' THEN 5 ELSE 0 END AS t
        FROM steps WHERE k < length(signature)
      )
    )
  )
), plans AS (
  SELECT conv_id, n0.c AS cost, n0.e AS audit FROM signed JOIN steps USING (signature) WHERE k = length(signature)
), edits AS (
  SELECT conv_id, e, p, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM plans)
  WHERE e <> ''
), stay AS (
  SELECT e.conv_id, e.p, e.e, CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS text, f.role, f.initial,
    count(*) FILTER (NOT (e.e = 'K' AND f.initial = 's')) OVER (PARTITION BY e.conv_id ORDER BY p) AS nth
  FROM edits e LEFT JOIN faults f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.place = f.place AND e.e <> 'I'
  WHERE e.e <> 'D'
), joined AS (
  SELECT conv_id, string_agg(
    CASE WHEN e = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole
  FROM stay GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN signed s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
"""
