"""Chat formatting from reply trees.

Messages point to the message they answer. Pointer doubling (each self-join doubles the distance covered) gives every
message its root, its depth and the sum of scores on its path, in log2(depth) joins; every leaf is one root-to-leaf
path. Branches of a tree are ranked by mean score, then length, then the smallest leaf id, and the best leaf's path is
marked by the reverse doubling: from the leaf, the ancestors at 2**k, 2**(k-1), ... steps. Joins are on message keys,
which are unique, so no hot key arises however many messages a tree has.

The chosen path is formatted turn by turn: ``<s>`` opens the conversation, each turn is ``[ROLE]``, a space, the escaped
text and ``</s>``. Control strings inside texts are escaped reversibly: every ``<`` ``[`` and ``\\`` that could start one
gets a backslash before it. Turns are formatted one row each; a conversation's output is its turns in order, read back
by a parser that needs nothing but the formatted text.

Defined results: a null text is empty, a null role is the empty role; rows with a null conv_id are one conversation; a
message whose parent is missing is a root; repeated rows are turns of their own; equal turns are ordered by role and
text; an empty table gives no conversations. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import stage
from carepath.operators.ordering import row_index

OPEN, CLOSE = "<s>", "</s>"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"[\\<\[\]]")
_TURN = re.compile(r"\[((?:[^\\\]]|\\.)*)\] ((?:[^\\<]|\\.)*)</s>", re.S)
_UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"[{escape(role)}] {escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, or of a part of it that starts and ends with a turn."""
    at = len(OPEN) if formatted.startswith(OPEN) else 0
    turns = []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages (id, parent, conv_id, role, text, score).

    Rows get distributed positions in the order of conversation and turn; a row's parent is the row before it if that
    is of the same conversation. One row per partition (its last) crosses partitions, so a conversation of any length
    needs no window of its own.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    numbered = stage(row_index(rows, ["conv_id", "turn", "role", "text"], "id"))
    before = numbered.select((F.col("id") + 1).alias("id"), F.col("id").alias("parent"), F.col("conv_id").alias("_conv"))
    joined = numbered.join(before, "id", "left")
    same = F.col("parent").isNotNull() & F.col("conv_id").eqNullSafe(F.col("_conv"))
    return joined.select("id", F.when(same, F.col("parent")).alias("parent"), "conv_id", "role", "text", F.lit(1.0).alias("score"))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer doubling -> (levels, paths).

    Level k is (id, up): the ancestor 2**k steps up, for the messages that have one. ``paths`` is (id, root, total,
    steps) of every message: its root, and the sum of scores and the number of messages on its path. A message whose
    pointer has passed the root is finished and joins no further level, so a few deep trees cost only their own rows.
    """
    known = messages.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    answers = messages.where(F.col("parent").isNotNull()).join(known, "parent", "left")
    opening = messages.where(F.col("parent").isNull()).withColumn("_there", F.lit(False))
    first = stage(
        answers.unionByName(opening).select(
            "id",
            F.when(F.col("_there"), F.col("parent")).alias("up"),
            F.col("id").alias("top"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
            F.lit(1).cast("long").alias("steps"),
        )
    )
    # A row covers the messages from ``id`` to ``top``; ``up`` is the next one above, null at a root.
    now, levels = first, []
    done = first.where(F.col("up").isNull())
    while True:
        going = now.where(F.col("up").isNotNull())
        if not going.take(1):
            return levels, done.select("id", F.col("top").alias("root"), "total", "steps")
        levels.append(going.select("id", "up"))
        above = going.union(done).select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("total").alias("_total"), F.col("steps").alias("_steps")
        )
        now = stage(
            going.join(above, "up").select(
                "id",
                F.col("_up").alias("up"),
                F.col("_top").alias("top"),
                (F.col("total") + F.col("_total")).alias("total"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
            )
        )
        done = stage(done.union(now.where(F.col("up").isNull())))


def best_paths(messages: DataFrame) -> DataFrame:
    """(id, root, depth): the messages on the best root-to-leaf path of each tree, depth 1 at the root."""
    levels, paths = ancestors(messages)
    if levels:
        leaves = paths.join(levels[0].select(F.col("up").alias("id")).distinct(), "id", "left_anti")
    else:
        leaves = paths
    rank = F.struct((F.col("total") / F.col("steps")).alias("mean"), F.col("steps"), (-F.col("id")).alias("smallest"))
    best = leaves.groupBy("root").agg(F.max(rank).alias("b")).select((-F.col("b.smallest")).alias("id"))
    path = stage(best)
    for level in reversed(levels):
        path = stage(path.union(level.join(path, "id").select(F.col("up").alias("id"))).distinct())
    return path.join(paths.select("id", "root", F.col("steps").alias("depth")), "id")


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [format_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        keep = [batch.column(n) for n in ("conv_id", "root", "depth")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(turns, pa.string())], ["conv_id", "root", "depth", "formatted"])


def format_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, root, depth, formatted): one row per turn of each chosen path."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    chosen = messages.select("id", "conv_id", "role", "text").join(best_paths(messages), "id")
    rows = chosen.select("conv_id", "root", "depth", "role", "text")
    return rows.mapInArrow(_format, f"conv_id {kind}, root long, depth long, formatted string")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from
    the formatted turns. Rows are sorted inside partitions of whole conversations and read as a stream: a task holds a
    hash state and one turn, never a conversation. The loss mask covers assistant texts."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        types = None
        for batch in batches:
            done = []
            types = batch.schema.field("conv_id").type
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "root", "formatted"))
            for conv, root, text in zip(*columns):
                if state is None or state[0] != root:
                    if state is not None:
                        done.append(state)
                    state = [root, conv, 0, sha256(), 0, sha256(), len(OPEN)]
                for role, said in parse(text):
                    state[2] += 1
                    state[3].update(f"{role}\n{said}\n".encode())
                    if role == LOSS_ROLE:
                        state[4] += len(said)
                        state[5].update(said.encode())
                state[6] += len(text)
            if done:
                yield _digests(done, types, names)
        if state is not None:
            yield _digests([state], types, names)

    ordered = formatted.repartition("root").sortWithinPartitions("root", "depth")
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(done: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s[1] for s in done], kind),
            pa.array([s[2] for s in done], pa.int64()),
            pa.array([s[3].hexdigest() for s in done], pa.string()),
            pa.array([s[4] for s in done], pa.int64()),
            pa.array([s[5].hexdigest() for s in done], pa.string()),
            pa.array([s[6] for s in done], pa.int64()),
        ],
        names,
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, text): whole formatted conversations, for data whose conversations fit a row."""
    turns = F.array_sort(F.collect_list(F.struct("depth", "formatted")))
    text = F.concat(F.lit(OPEN), F.array_join(F.transform(turns, lambda t: t["formatted"]), ""))
    return formatted.groupBy("root").agg(F.first("conv_id").alias("conv_id"), text.alias("text")).drop("root")
