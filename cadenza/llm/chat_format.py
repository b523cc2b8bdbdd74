"""Chat formatting of reply trees: root-to-leaf paths as training conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._shared import dropped, written

#: Template: "### role: text</turn>\n" for each turn. In texts and roles, what could be a control string is escaped.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_ROLE_ESCAPES = _ESCAPES | {":": "\\c", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ROLE_ESCAPES.items()}
_TEXT_TABLE, _ROLE_TABLE = str.maketrans(_ESCAPES), str.maketrans(_ROLE_ESCAPES)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def formatted(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string and the loss mask: (start, end) code points of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{role.translate(_ROLE_TABLE)}{COLON}", text.translate(_TEXT_TABLE)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


def parsed(conversation: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out = []
    for turn in conversation.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(COLON)
        out.append((unescaped(role), unescaped(text)))
    return out


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, position, node): the nodes of the chosen root-to-leaf paths, from position 1, the root.

    nodes: tree, node, parent, score (double); node is unique in its tree. A
    node whose parent is null or not in the tree is a root. A path's score is
    the sum of its nodes'; the paths of a tree are ranked by score, then by
    leaf, and the first ``top`` are chosen (None: all). Nodes on a cycle lie on
    no path.

    Self-joins double the distance to each node's known ancestor, so a chain
    of n replies takes log2(n) of them; the same tables, read from the longest
    distance down, then list the ancestors of the chosen leaves only.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("known"))
    linked = nodes.join(known, _same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("known")), "left")
    first = written(linked.select("tree", "node", F.col("known").alias("up"), "score", F.lit(1).cast("long").alias("steps")), "replies")
    # A node whose root is found rests in done; the others, in open, know an ancestor 1, 2, 4, ... steps up.
    done, open_, tables = first.filter("up is null"), first.filter("up is not null"), []
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if open_.isEmpty():
            break
        tables.append(open_)
        far = done.unionByName(open_).select(F.col("tree").alias("t"), F.col("node").alias("mid"), F.col("up").alias("far"), F.col("score").alias("more"), F.col("steps").alias("on"))
        joined = open_.join(far, _same(F.col("tree"), F.col("t")) & (F.col("up") == F.col("mid")))
        up = written(joined.select("tree", "node", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("on")).alias("steps")), "replies")
        done, open_ = done.unionByName(up.filter("up is null")), up.filter("up is not null")
    inner = first.filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("inner")).distinct()
    leaves = done.join(inner, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("inner")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    found = written(ranked.select("tree", F.col("node").alias("leaf"), "rank", F.col("steps").alias("position"), "node"), "paths")
    for table in reversed(tables):
        # Written at every level, so that no plan holds more than one join.
        jump = table.select(F.col("tree").alias("t"), F.col("node").alias("from"), "up", "steps")
        more = found.join(jump, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("from")))
        more = found.unionByName(more.select("tree", "leaf", "rank", (F.col("position") - F.col("steps")).alias("position"), F.col("up").alias("node")))
        before, found = found, written(more, "paths")
        dropped(before)
    return found


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, conversation, loss_spans): every chosen path formatted as one conversation.

    messages: tree, node, parent, score, role, text. Null roles and texts are
    empty. loss_spans are the code points of the assistant's (escaped) texts.
    An empty table gives an empty result; only these six columns are read.
    """
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = paths(messages, top)
    turns = chosen.join(texts, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n")))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [formatted([(t["role"], t["text"]) for t in turns]) for turns in b.column(3).to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in x] for _, x in done]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x for x, _ in done], pa.string()), pa.array(spans, span)], names=["tree", "leaf", "rank", "conversation", "loss_spans"])

    kinds = dict(grouped.dtypes)
    return grouped.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank long, conversation string, loss_spans array<struct<start: long, end: long>>")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of the conversations in rows (conv_id, turn, role, text): every turn replies to the one before.

    Turns of a conversation are ordered by turn (null last), then role and
    text (null as empty), so repeated turns all stay. Rows with a null conv_id
    form one conversation. The score of a message is the length of its text.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = rows.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree, turns, loss): the turns and the text under the loss mask, both read from the formatted string alone."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, losses = [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns.append([{"role": r, "text": t} for r, t in parsed(text)])
                losses.append("".join(unescaped(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(turns, turn), pa.array(losses, pa.string())], names=["tree", "conversation", "turns", "loss"])

    kind = dict(conversations.dtypes)["tree"]
    return conversations.select("tree", "conversation", "loss_spans").mapInArrow(run, f"tree {kind}, conversation string, turns array<struct<role: string, text: string>>, loss string")


def op2_chat_formatting(spark, sf_dir):
    """Every conversation formatted and read back; edge cases as in ``from_turns`` and ``format_trees``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = read_back(format_trees(from_turns(rows.unionByName(added)), 1))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    replace(replace(replace(coalesce(text, ''), '\', '\\'), '#', '\h'), '<', '\l') AS etext,
    replace(replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c'), chr(10), '\n') AS erole
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + length(erole) + 14) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
