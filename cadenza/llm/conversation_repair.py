"""Repair of damaged conversations by the cheapest edits, with a lazily determinised weighted automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._shared import leaning

#: Costs of the edits; a truncated row that stays costs more.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of the pattern (s?(ua)+)?: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after the user or assistant row that a state still allows.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (START, ASSISTANT)
#: The first characters of roles and the faults, as symbols read them; other characters fit no state.
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")


def _closed(costs: list[int]) -> list[int]:
    """Costs to the end from every state, where rows may be inserted first."""
    for _ in range(len(costs)):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return costs


class Automaton:
    """Costs to the end of a conversation, read from its last row to its first.

    Its states are vectors: the cheapest cost of the rest from each state of
    the pattern, less the least of them. There are few, as a row can always be
    deleted or inserted at a bounded cost. A state and a row's symbol (initial
    and fault) give the state before the row and what the least grows by; both
    are worked out when they first occur and looked up afterwards.
    """

    def __init__(self):
        self.states: list[tuple[int, ...]] = []
        self.place: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str, int], tuple[int, int]] = {}
        self.moves: dict[tuple[int, str, int, int], tuple[str, int, int]] = {}
        infinite = INSERT * len(_NEXT)
        self.end = self.state(_closed([0 if q in _ENDS else infinite for q in range(len(_NEXT))]))

    def state(self, vector: list[int]) -> int:
        found = self.place.setdefault(tuple(vector), len(self.states))
        if found == len(self.states):
            self.states.append(tuple(vector))
        return found

    def _kept(self, initial: str, fault: int, after: tuple[int, ...], q: int) -> Iterator[tuple[str, int, int]]:
        """The edits of a row in state q that need no insertion: (initial, cost, state after)."""
        yield "D", DELETE, q
        if FAULTS[fault] in ("none", "truncated"):
            more = TRUNCATED if FAULTS[fault] == "truncated" else 0
            if (q, initial) in _KEEP:
                yield "K", more, _KEEP[q, initial]
            yield "R", REROLE + more, _NEXT[q]

    def before(self, state: int, initial: str, fault: int) -> tuple[int, int]:
        """The state before a row, from that after it, and the growth of the least cost."""
        key = (state, initial, fault)
        if key not in self.table:
            after = self.states[state]
            costs = _closed([min(c + after[to] for _, c, to in self._kept(initial, fault, after, q)) for q in range(len(_NEXT))])
            least = min(costs)
            self.table[key] = self.state([c - least for c in costs]), least
        return self.table[key]

    def move(self, state: int, initial: str, fault: int, q: int) -> tuple[str, int, int]:
        """(edits, state of the pattern, cost) of a row in state q of the pattern; state: of the automaton after the row.

        Only arcs that keep the cheapest cost are followed (tight ones), of
        several the one whose initial comes first. Every initial leads to one
        state, so the audit is the least of the cheapest.
        """
        key = (state, initial, fault, q)
        if key not in self.moves:
            after = self.states[state]
            to, grown = self.before(state, initial, fault)
            costs = [c + grown for c in self.states[to]]
            edits, spent, at = "", 0, q
            while not edits or edits[-1] == "I":
                arcs = [*self._kept(initial, fault, after, at), ("I", INSERT, _NEXT[at])]
                tight = [(e, c, s) for e, c, s in arcs if c + (costs[s] if e == "I" else after[s]) == costs[at]]
                edit, cost, at = min(tight)
                edits, spent = edits + edit, spent + cost
            self.moves[key] = edits, at, spent
        return self.moves[key]

    def last(self, q: int) -> tuple[str, int]:
        """The insertions after the last row, and their cost."""
        n = 0
        while q not in _ENDS:
            n, q = n + 1, _NEXT[q]
        return "I" * n, INSERT * n


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults: (conv_id, turn, role, text, gone) by crc32 of ``conv_id:turn`` modulo 20.

    0: the row is gone (it stays as a mark of its conversation), 1: its text is
    empty, 2: it loses its full stops, exclamation and question marks, 3: it
    comes twice, 4: its role is user. Nulls in roles, texts and that key are one space.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate").isin(0, 1), "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_fate") == 0).alias("gone"), F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1)).alias("_times"))
    return rows.withColumn("_time", F.explode("_times")).drop("_times", "_time")


def faulty(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with place (from 1, by turn, role and text) and fault, an index of ``FAULTS``.

    Each conversation meets once, in one partition, for this and the repair;
    a row's window is streamed, not held.
    """
    own = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text", "_seen")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), FAULTS.index("blank")).when(F.col("_seen") > 1, FAULTS.index("duplicate"))
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FAULTS.index("truncated")).otherwise(FAULTS.index("none"))
    )
    met = rows.repartition("conv_id").withColumn("_seen", F.row_number().over(own)).withColumn("place", F.row_number().over(order))
    return met.select("conv_id", "place", "turn", "role", "text", "gone", fault.cast("int").alias("fault"))


def _initial(role: str) -> str:
    return role[0] if role and role[0] in INITIALS else "x"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``ahead`` to rows sorted from a conversation's last to its first: the automaton's state after the row, as its vector."""
    automaton, conv, state = Automaton(), object(), 0
    for b in batches:
        ahead = []
        for conv_id, role, gone, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "gone", "fault"))):
            if conv_id != conv:
                conv, state = conv_id, automaton.end
            ahead.append(automaton.states[state])
            if not gone:
                state, _ = automaton.before(state, _initial(role), fault)
        yield b.append_column("ahead", pa.array(ahead, pa.list_(pa.int32())))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Follows the tight arcs from a conversation's first row to its last.

    One tuple an edit: (conv_id, edit, cost, role, text, turn, initial, fault);
    role is the one given (null: deleted), turn to fault are those of the row
    (null: inserted). A row that is gone gives a tuple without an edit.
    """
    automaton, conv, q = Automaton(), object(), START

    def inserted(edits: str, at: int) -> Iterator[tuple]:
        for _ in edits:
            at = _NEXT[at]
            yield conv, "I", INSERT, _ROLE[at], "", None, None, None

    for b in batches:
        for conv_id, turn, role, text, gone, fault, ahead in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault", "ahead"))):
            if conv_id != conv:
                yield from inserted(automaton.last(q)[0], q)
                conv, q = conv_id, START
            if gone:
                yield conv, "", 0, None, None, None, None, None
                continue
            edits, to, cost = automaton.move(automaton.state(ahead), _initial(role), fault, q)
            yield from inserted(edits[:-1], q)
            edit = edits[-1]
            yield conv, edit, cost - INSERT * (len(edits) - 1), None if edit == "D" else role if edit == "K" else _ROLE[to], text, turn, role[:1], fault
            q = to
    yield from inserted(automaton.last(q)[0], q)


def _sorted(rows: DataFrame) -> DataFrame:
    """rows of ``faulty`` with ``ahead``, by conversation and place; both sorts stay in the partition, on disk where they must."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    scanned = rows.sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(leaning(_scan), f"{kinds}, ahead array<int>")
    return scanned.sortWithinPartitions("conv_id", "place")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, n, edit, cost, role, text): the edits of rows (conv_id, turn, role, text, gone) in order.

    edit: K (kept), R (another role), D (deleted; role is null), I (inserted,
    with an empty text); the edited rows' roles begin with (s?(ua)+)?. The sum
    of cost is least, and of those the edits come first in ASCII order.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, edits in groupby(_edits(batches), key=lambda e: e[0]):
            out: list[tuple] = []
            for n, e in enumerate((e for e in edits if e[1]), 1):
                out.append((conv, n, *e[1:5]))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _sorted(faulty(rows)).mapInArrow(leaning(run), "conv_id long, n long, edit string, cost long, role string, text string")


def audited(rows: DataFrame) -> DataFrame:
    """One row for every conversation of rows (conv_id, turn, role, text, gone), also where all of them are gone.

    gaps: missing turns between the least and the greatest (nulls don't count).
    blank, duplicate, truncated: rows by their first fault. illegal: neighbours
    whose role initials aren't su, ua or au. cost and audit: the cheapest edits
    as in ``repaired``, by their letters. repaired_sha256: of the edited rows
    as ``role:text``, with newlines between.

    Nulls: a null turn comes first; a null conv_id is a conversation of its
    own; null roles and texts count as one space (no role that can stay, and a
    blank text). Equal turns come by role and text, so a row and its repetition
    are neighbours. A role that is empty or begins with another letter can't
    stay as it is. An empty table gives an empty result. Other columns aren't
    read. A conversation's rows stream through one task, as its audit and hash
    are sequences; a task holds the audit and a batch of rows.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def summed(conv: int | None, edits: Iterator[tuple]) -> tuple:
        faults, cost, illegal, audit = [0] * len(FAULTS), 0, 0, bytearray()
        least = greatest = turn = initial = None
        distinct, digest, any_row = 0, hashlib.sha256(), False
        for _, edit, spent, role, text, own_turn, own_initial, fault in edits:
            cost += spent
            audit += edit.encode()
            if role is not None:
                digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_row = True
            if own_initial is None:
                continue
            faults[fault] += 1
            illegal += initial is not None and initial + own_initial not in ("su", "ua", "au")
            initial = own_initial
            if own_turn is not None and own_turn != turn:
                turn, distinct = own_turn, distinct + 1
                least, greatest = turn if least is None else least, turn
        gaps = 0 if least is None else greatest - least + 1 - distinct
        return conv, gaps, *faults[1:], illegal, cost, audit.decode(), digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, edits in groupby(_edits(batches), key=lambda e: e[0]):
            out.append(summed(conv, edits))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _sorted(faulty(rows)).mapInArrow(leaning(run), f"conv_id long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def op13_conversation_structure_repair(spark, sf_dir):
    """Every conversation damaged and repaired; edge cases as in ``damaged`` and ``audited``."""
    return audited(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP13_SQL = r"""
WITH RECURSIVE octets AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crcs AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(octets.crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fate
  FROM given, octets),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM crcs WHERE fate <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS times FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, times) AS i, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
arcs(q, needs, edit, q2, cost) AS (VALUES
  (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0), (0, NULL, 'R', 2, 1), (1, NULL, 'R', 2, 1), (2, NULL, 'R', 3, 1), (3, NULL, 'R', 2, 1),
  (0, NULL, 'D', 0, 2), (1, NULL, 'D', 1, 2), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 3, 2)),
inserts(q, edits, q1, cost, added) AS (VALUES
  (0, '', 0, 0, []), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []), (0, 'I', 2, 5, ['user:']), (1, 'I', 2, 5, ['user:']), (2, 'I', 3, 5, ['assistant:']), (3, 'I', 2, 5, ['user:']),
  (0, 'II', 3, 10, ['user:', 'assistant:']), (1, 'II', 3, 10, ['user:', 'assistant:']), (2, 'II', 2, 10, ['assistant:', 'user:']), (3, 'II', 3, 10, ['user:', 'assistant:'])),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])} AS path FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL
  SELECT p.conv_id, r.i, a.q2, min({
    'cost': p.path.cost + n.cost + a.cost + CASE WHEN a.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.path.audit || n.edits || a.edit,
    'said': p.path.said || n.added || CASE a.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE a.q2 WHEN 3 THEN 'assistant:' ELSE 'user:' END || r.text] END})
  FROM paths p JOIN placed r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN inserts n ON n.q = p.q JOIN arcs a ON a.q = n.q1 AND (a.needs IS NULL OR a.needs = r.initial)
  WHERE a.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate') GROUP BY p.conv_id, r.i, a.q2),
ended AS (
  SELECT p.conv_id, min({'cost': p.path.cost + n.cost, 'audit': p.path.audit || n.edits, 'said': p.path.said || n.added}) AS path
  FROM paths p JOIN inserts n ON n.q = p.q AND n.q1 IN (0, 3) WHERE p.i = (SELECT max(i) FROM placed r WHERE r.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY p.conv_id),
neighbours AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM neighbours GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.path.cost, 0) AS BIGINT) AS cost, coalesce(e.path.audit, '') AS audit, sha256(coalesce(array_to_string(e.path.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
