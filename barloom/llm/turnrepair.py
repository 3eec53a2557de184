"""Repair of conversations: the cheapest edits that make their roles an optional system turn and user-assistant pairs.

Four states read a repaired conversation: nothing yet, after the system turn, after a user's, after an assistant's. Every
row is kept (0), gets another role (2) or is deleted (3, required for blank and repeated rows); empty turns may be
inserted anywhere (2), and a truncated row that stays costs 1. The audit of a repair are its edits' initials in order.

The edits come from Hirschberg's divide and conquer: costs from the front over one half of the rows and from the back over
the other are two vectors of four numbers each; their cheapest sum says in which state an optimal repair crosses the
middle, and both halves follow by recursion. No table of all rows is kept. With the forward costs goes the order of the
four states' least audits: audits over the same rows end with a row's letter, so none is the beginning of another, and
their order alone decides which optimal crossing has the ASCII-least audit.

Rows travel without their texts until the audits are known; texts then stream past them once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.prefixtrie import CRC32_SQL
from barloom.session import cut_lineage

BLANKS, STOPS = " \t\n\x0b\f\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States, and what a user's or an assistant's turn makes of them (-1: it can't stand there).
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1), "": (-1, -1, -1, -1)}
_CLASSES = ("s", "u", "a", "")
SOUND, CUT, GONE = range(3)
NEVER = 1 << 60
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _inserted(state: int) -> int:
    """The state after the one role that can be inserted."""
    return ASSISTANT if state == USER else USER


def _steps(kind: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of a row of a kind (3 * class + condition), inserts before it included: the best each."""
    role, condition = _CLASSES[kind // 3], kind % 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(4):
        state, paid, letters = begin, 0, ""
        for _ in range(3):  # a third insert only comes back to an earlier state
            edits = [(state, DELETE, "D")]
            if condition != GONE:
                extra = TRUNCATED * (condition == CUT)
                edits += [(_AFTER[role][state], KEEP + extra, "K"), (_inserted(state), REROLE + extra, "R")]
            for end, cost, letter in edits:
                if end >= 0:
                    found = (paid + cost, letters + letter)
                    best[begin, end] = min(best.get((begin, end), found), found)
            state, paid, letters = _inserted(state), paid + INSERT, letters + "I"
    return [(a, b, cost, letters) for (a, b), (cost, letters) in sorted(best.items())]


_STEPS = [_steps(kind) for kind in range(12)]
_LETTERS = [{(a, b): letters for a, b, _, letters in steps} for steps in _STEPS]
#: How a repair ends from each state: cost and letters.
_ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _forward(kinds: bytes, begin: int, end: int, state: int) -> tuple[list[int], list[int]]:
    """Costs of reaching each state from ``state`` over rows begin..end, and the order of the states' least audits."""
    costs, order = [NEVER] * 4, [0] * 4
    costs[state] = 0
    for k in kinds[begin:end]:
        found: list[tuple[int, int, str]] = [(NEVER, 0, "")] * 4
        for a, b, cost, letters in _STEPS[k]:
            if costs[a] < NEVER:
                one = (costs[a] + cost, order[a], letters)
                if one < found[b]:
                    found[b] = one
        costs = [x[0] for x in found]
        for place, b in enumerate(sorted(range(4), key=lambda b: found[b][1:])):
            order[b] = place
    return costs, order


def _backward(kinds: bytes, begin: int, end: int, state: int) -> list[int]:
    """Costs of reaching ``state`` from each state over rows begin..end."""
    costs = [NEVER] * 4
    costs[state] = 0
    for k in reversed(kinds[begin:end]):
        before = [NEVER] * 4
        for a, b, cost, _ in _STEPS[k]:
            if costs[b] + cost < before[a]:
                before[a] = costs[b] + cost
        costs = before
    return costs


def _between(kinds: bytes, begin: int, end: int, start: int, stop: int, out: list[str]) -> None:
    if end - begin == 1:
        out.append(_LETTERS[kinds[begin]][start, stop])
        return
    middle = (begin + end) // 2
    costs, order = _forward(kinds, begin, middle, start)
    rest = _backward(kinds, middle, end, stop)
    cross = min(range(4), key=lambda s: (costs[s] + rest[s], order[s]))
    _between(kinds, begin, middle, start, cross, out)
    _between(kinds, middle, end, cross, stop, out)


def cheapest_edits(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows of these kinds, the ASCII-least of equally cheap ones."""
    if not kinds:
        return 0, ""
    costs, order = _forward(kinds, 0, len(kinds), START)
    last = min(range(4), key=lambda s: (costs[s] + _ENDS[s][0], order[s]))
    out: list[str] = []
    _between(kinds, 0, len(kinds), START, last, out)
    return costs[last] + _ENDS[last][0], "".join(out) + _ENDS[last][1]


_remembered = lru_cache(maxsize=1 << 14)(cheapest_edits)


def _checked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv, turn, k1, k2, copy, initial, and whether they are blank or truncated."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv", "turn", "k1", "k2", "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), (bare == "").alias("is_blank"), (~F.substring(bare, -1, 1).isin(*STOPS)).alias("is_cut")
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("copy")]


def _summaries(rows: DataFrame) -> DataFrame:
    """conv and its counts, cost and audit."""
    slim = _checked(rows).withColumn("nth", F.row_number().over(Window.partitionBy("conv", "k1", "k2").orderBy(*_order())))
    walk = Window.partitionBy("conv").orderBy(*_order())
    pair = F.concat(F.lag("initial").over(walk), F.col("initial"))
    fault = F.when(F.col("is_blank"), 1).when(F.col("nth") > 1, 2).when(F.col("is_cut"), 3).otherwise(0)
    marked = slim.withColumns({
        "fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("int"), "ord": F.row_number().over(walk),
        "fresh": F.coalesce(F.col("turn") != F.coalesce(F.lag("turn").over(walk), F.col("turn") - 1), F.lit(False)).cast("int"),
    })
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3) * 3
    kind = kind + F.when(F.col("fault") == 3, CUT).when(F.col("fault") > 0, GONE).otherwise(SOUND)
    facts = marked.groupBy("conv").agg(
        *[F.count(F.when(F.col("fault") == i, 1)).alias(name) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
        F.sum("illegal").alias("illegal"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("fresh"), F.lit(0)).cast("long").alias("gaps"),
    )
    stream = marked.select("conv", "ord", kind.cast("int").alias("kind")).sortWithinPartitions("conv", "ord")
    audits = stream.select("conv", "kind").mapInPandas(_audited, "conv string, cost long, audit string")
    return facts.withColumnRenamed("conv", "c").join(audits, F.col("c").eqNullSafe(F.col("conv"))).select("conv", *[x.split()[0] for x in SUMMARY.split(", ")])


def _runs(values: np.ndarray) -> Iterator[tuple[object, int, int]]:
    """Stretches of equal neighbours: value, begin, end."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *edges.tolist(), len(values)]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        yield values[begin], begin, end


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audits from rows in order; of a conversation only one byte a row is held."""
    nothing = object()
    now, held = nothing, bytearray()
    for rows in batches:
        out = []
        kinds = rows["kind"].to_numpy(np.uint8).tobytes()
        for conv, begin, end in _runs(rows["conv"].to_numpy(object)) if len(rows) else ():
            if conv != now:
                if now is not nothing:
                    out.append((now, *_remembered(bytes(held))))
                now, held = conv, bytearray()
            held += kinds[begin:end]
        yield pd.DataFrame(out, columns=["conv", "cost", "audit"])
    if now is not nothing:
        yield pd.DataFrame([(now, *_remembered(bytes(held)))], columns=["conv", "cost", "audit"])


_ROLES = {USER: "user", ASSISTANT: "assistant"}


class _Repair:
    """Walks an audit while the rows of its conversation pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _inserted(self.state)
            yield _ROLES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            self.state = _inserted(self.state)
            role = _ROLES[self.state]
        else:
            self.state = _AFTER[role[:1]][self.state]
        yield role, text, letter


def _streamed(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each conversation's audit and after it its rows in order, neither of them split between tasks."""
    texts = rows.select("conv", F.lit(1).alias("part"), "turn", "k1", "k2", "copy", "role", "text")
    null = F.lit(None).cast("long")
    audits = summaries.select("conv", F.lit(0).alias("part"), null.alias("turn"), null.alias("k1"), null.alias("k2"), F.lit(0).alias("copy"), F.lit("").alias("role"), F.coalesce("audit", F.lit("")).alias("text"))
    both = audits.unionByName(texts).repartition("conv")
    return both.sortWithinPartitions("conv", "part", *_order()).select("conv", "part", "role", "text")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[object, str | None, str | None, str]]]:
    """Turns of repaired conversations, batch by batch: conv, role, text, edit; a row without a role begins a conversation."""
    now: _Repair | None = None
    conv: object = None
    for rows in batches:
        out: list[tuple[object, str | None, str | None, str]] = []
        for c, part, role, text in zip(rows["conv"], rows["part"], rows["role"], rows["text"], strict=True):
            if part == 0:
                if now is not None:
                    out += [(conv, *x) for x in now.inserts()]
                conv, now = c, _Repair(text)
                out.append((conv, None, None, ""))
            else:
                out += [(conv, *x) for x in now.row(role, text)]
        yield out
    if now is not None:
        yield [(conv, *x) for x in now.inserts()]


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place = 0
    for turns in _repaired(batches):
        out = []
        for conv, role, text, edit in turns:
            if role is None:
                place = 0
            else:
                out.append((conv, place, role, text, edit))
                place += 1
        yield pd.DataFrame(out, columns=["conv", "place", "role", "text", "edit"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv and SHA-256 of its repaired lines."""
    nothing = object()
    now, digest, first = nothing, hashlib.sha256(), True
    for turns in _repaired(batches):
        out = []
        for conv, role, text, _ in turns:
            if role is None:
                if now is not nothing:
                    out.append((now, digest.hexdigest()))
                now, digest, first = conv, hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if now is not nothing:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def _prepared(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv (conv_id as text), turn, role, text, copy, and two hashes of role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.explode(F.array(F.lit(0)) if copies is None else copies).alias("copy"),
    )
    return rows.withColumns({"k1": F.xxhash64(F.lit(1), "role", "text"), "k2": F.xxhash64(F.lit(2), "text", "role")})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and copy after faults that a hash of conv_id and turn decides; nulls become one space."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(named) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault"),
    )
    return _prepared(rows.where("fault <> 0"), F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def _all_summaries(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    convs = conversations.groupBy(F.col("conv_id").cast("string").alias("c")).agg(F.first(F.lit(1)).alias("one"))
    found = convs.join(_summaries(rows), F.col("c").eqNullSafe(F.col("conv")), "left")
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    return cut_lineage(found.select(F.col("c").alias("conv"), *[F.coalesce(x, F.lit("" if x == "audit" else 0)).alias(x) for x in names]))


def repair_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text and edit (K, R or I) of all repaired conversations.

    Rows are taken by turn, null first; rows that share one by hashes of role and text. A null role or text is one space,
    which makes a role no role and a text blank. Rows with a null conv_id are one conversation. Rows that repeat in full
    are duplicates. A conversation whose rows all go has none. Other columns are ignored, an empty table gives no rows.
    """
    rows = _prepared(conversations)
    out = _streamed(rows, _all_summaries(conversations, rows)).mapInPandas(_numbered, "conv string, place long, role string, text string, edit string")
    return out.select(F.col("conv").cast("long").alias("conv_id"), "place", "role", "text", "edit")


def audit_conversations(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` are the rows that are audited, as ``damaged`` returns them; a conversation without any has zeros, an empty
    audit and the hash of nothing. Nulls and ties are as in ``repair_turns``. An empty table gives no rows.
    """
    summaries = _all_summaries(conversations, rows)
    hashes = _streamed(rows, summaries).mapInPandas(_digests, "conv string, repaired_sha256 string").withColumnRenamed("conv", "h")
    out = summaries.join(hashes, F.col("conv").eqNullSafe(F.col("h")))
    return out.select(F.col("conv").cast("long").alias("conv_id"), *[x.split()[0] for x in SUMMARY.split(", ")], "repaired_sha256")


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits and repairs of all conversations after their damage."""
    conversations = table(spark, sf_dir, "conversations")
    return audit_conversations(conversations, damaged(conversations))


OP13_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
marked AS (SELECT *, {CRC32_SQL.format("k")} % 20 AS fault FROM named),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER w AS ord, lag(role) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, left(role, 1) AS r, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE wrong) AS illegal, max(ord) AS n
  FROM faults GROUP BY conv_id),
-- states 0 to 3; up to two inserts, then a letter for the row
inserts(q, p, paid, letters, lines) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
         (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (3, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:'])),
edits(letter, cost) AS (VALUES ('D', 3), ('K', 0), ('R', 2)),
walk AS (
  SELECT conv_id, 0 AS ord, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM facts
  UNION ALL
  SELECT conv_id, ord, state, b.cost, b.audit, b.lines FROM (
    SELECT w.conv_id, f.ord,
           CASE WHEN e.letter = 'D' THEN i.p WHEN e.letter = 'R' THEN CASE WHEN i.p = 2 THEN 3 ELSE 2 END WHEN f.r = 's' THEN 1 WHEN f.r = 'u' THEN 2 ELSE 3 END AS state,
           min({{'cost': w.cost + i.paid + e.cost + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || i.letters || e.letter,
                'lines': list_concat(w.lines, i.lines, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE WHEN i.p = 2 THEN 'assistant:' ELSE 'user:' END || f.text] END)}}) AS b
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.ord = w.ord + 1 JOIN inserts i ON i.q = w.state CROSS JOIN edits e
    WHERE e.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR (f.r = 's' AND i.p = 0) OR (f.r = 'u' AND i.p <> 2) OR (f.r = 'a' AND i.p = 2)))
    GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({{'cost': w.cost + i.paid, 'audit': w.audit || i.letters, 'lines': list_concat(w.lines, i.lines)}}) AS b
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.ord JOIN inserts i ON i.q = w.state WHERE i.p IN (0, 3) GROUP BY w.conv_id)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
