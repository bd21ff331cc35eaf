"""Chat formatting: reply trees to ranked paths, each chosen path as one conversation."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows, runs
from recordweave.session import stage

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
PART = 1_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def key(column: str = "conv_id") -> Column:
    """A conversation's key, so that a null id is a conversation like any other."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, root_id, branch, depth, role, text) along the ``top`` best root-to-leaf paths of every tree.

    ``nodes`` has conv_id, node_id, parent_id, role, text, score. A node whose parent
    is null or not there is a root, so a conversation may hold several trees, told apart by ``root_id``. The
    leaves of a tree are ranked (``branch``, from 1): highest mean score along the path, then the longest path, then the
    smallest node_id. A null score counts as 0. Of rows with the same node one stays (smallest
    role, text). Nodes on a cycle reach no root and belong to no path.

    Every self-join doubles the step: after k of them each node knows its 2^k-th
    ancestor with the depth and score gathered on the way, and its root once that is reached, so a chain of n turns takes
    log2(n) joins. The steps are kept as tables, and the chosen paths are read out of them with as
    many joins, one row for each turn of a path and never one for each pair.
    """
    clean = (
        nodes.select(key().alias("c"), "conv_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .filter("node_id is not null")
        .withColumn("_r", F.row_number().over(Window.partitionBy("c", "node_id").orderBy("role", "text", "parent_id")))
        .filter("_r = 1")
        .drop("_r")
    )
    own = stage(clean, "nodes")
    there = own.select("c", F.col("node_id").alias("up"), F.lit(True).alias("known"))
    step = stage(
        own.select("c", "node_id", F.col("parent_id").alias("up"), "score")
        .join(there, ["c", "up"], "left")
        .select("c", "node_id", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known").isNull(), F.col("node_id")).alias("root_id"),
                F.lit(1).cast("bigint").alias("depth"), "score"),
        "step",
    )
    steps, ended, rows = [step], [step.filter("up is null")], own.count()
    for _ in range(max(1, rows).bit_length()):
        active = steps[-1].filter("up is not null")
        if not active.limit(1).count():
            break
        # only nodes still under way are joined; those at a root keep what they have
        far = reduce(DataFrame.union, [*ended, active]).select(
            "c", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("depth").alias("d2"), F.col("score").alias("s2")
        )
        step = stage(
            active.join(far, ["c", "up"]).select(
                "c", "node_id", F.col("up2").alias("up"), F.col("root2").alias("root_id"), (F.col("depth") + F.col("d2")).alias("depth"),
                (F.col("score") + F.col("s2")).alias("score"),
            ),
            "step",
        )
        steps.append(step)
        ended.append(step.filter("up is null"))
    rooted = reduce(DataFrame.union, ended)
    leaves = rooted.join(
        own.select("c", F.col("parent_id").alias("node_id")).distinct(), ["c", "node_id"], "left_anti"
    )
    # Spark cuts each tree to ``top`` leaves before the shuffle, so a tree of any width is never sorted whole
    rank = Window.partitionBy("c", "root_id").orderBy(F.desc(F.round(F.col("score") / F.col("depth"), 9)), F.desc("depth"), "node_id")
    best = leaves.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= top).select("c", "root_id", "branch", "node_id", "depth")
    path = stage(best, "path")
    for k in range(len(steps) - 2, -1, -1):
        jump = steps[k].filter("up is not null").select("c", "node_id", "up")
        up = path.join(jump, ["c", "node_id"]).select("c", "root_id", "branch", F.col("up").alias("node_id"), (F.col("depth") - 2**k).alias("depth"))
        path = stage(path.union(up), "path")  # written, since it is used twice in the next round
    return path.join(own, ["c", "node_id"]).select("conv_id", "root_id", "branch", "depth", "role", "text")


def format_paths(path: DataFrame) -> DataFrame:
    """(conv_id, root_id, branch, part, formatted, loss): each path as one conversation, in parts of about a million characters.

    A turn is ``### role: text</turn>`` and a line feed; a backslash goes before every
    backslash, ``###`` and ``</turn>`` of a text and before ``:`` of a role. ``loss`` holds the
    (start, end) of assistant texts in the part. Turns are streamed in order, so a
    path of any length is never held whole.
    """
    dealt = (
        path.select(key().alias("c"), "root_id", "branch", "depth", "conv_id", "role", "text")
        .repartition("c", "root_id", "branch").sortWithinPartitions("c", "root_id", "branch", "depth")
    )

    def write(rows):
        last, out, spans, at, part, conv = None, [], [], 0, 0, None
        for c, root, branch, _, conv_id, role, text in rows:
            own = c, root, branch
            if out and (own != last or at >= PART):
                yield conv, *last[1:], part, "".join(out), spans
                part, out, spans, at = part + 1, [], [], 0
            if own != last:
                part = 0
            last, conv = own, conv_id
            head, body = OPEN + escape_role(role) + COLON, escape(text)
            if role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body)))
            out.append(head + body + CLOSE)
            at += len(out[-1])
        if out:
            yield conv, *last[1:], part, "".join(out), spans

    return map_rows(
        dealt, write, "conv_id bigint, root_id bigint, branch int, part int, formatted string, loss array<struct<start:bigint,end:bigint>>", rows=64
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, root_id, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted parts."""
    dealt = (
        formatted.select(key().alias("c"), "root_id", "branch", "part", "conv_id", "formatted", "loss")
        .repartition("c", "root_id", "branch").sortWithinPartitions("c", "root_id", "branch", "part")
    )

    def read(rows):
        last = state = None
        for c, root, branch, _, conv_id, text, loss in rows:
            if state is None or (c, root, branch) != last:
                if state is not None:
                    yield done(last, state)
                last, state = (c, root, branch), [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            while at < len(text):
                found = TURN.match(text, at)
                state[1] += 1
                state[2].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                at = found.end()
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if state is not None:
            yield done(last, state)

    def done(own, s):
        return s[0], *own[1:], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    return map_rows(
        dealt, read,
        "conv_id bigint, root_id bigint, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def linear_nodes(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees: each row replies to the one before it.

    Rows are ordered by turn (nulls first), then role and text; repeated rows stay.
    """
    order = Window.partitionBy(key()).orderBy("turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("bigint")).select(
        "conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"),
    )


PROBE = "\\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum(length('### : </turn>') + 1 + length(replace(replace(role, '\', '\\'), ':', '\:'))
           + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
