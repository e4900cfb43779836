"""Chat formatting: speakers of a transcript by a hidden Markov model, then canonical turns.

The hidden states are roles; what is seen of a line is its speaker marker, if it has one, and features of its text
(length, lines, question mark, first in the conversation). Viterbi finds the likeliest roles of a whole conversation.
A conversation is cut into spans of bounded length: a span is summed up by a (roles x roles) max-plus matrix, the
matrices of a conversation give the roles at its cuts, and each span is then decoded between these, so that no task
holds a conversation whole and the result is that of one pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: The markers by which transcripts name a speaker, in lower case.
MARKERS = {"user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant", "system": "system", "instruction": "system", "instructions": "system", "tool": "tool", "function": "tool"}
MARKER = "^\\s*(?:<\\|?|\\[|#{1,4}\\s*|\\*\\*)?([A-Za-z]{1,12})(?:\\|?>|\\]|\\*\\*)?\\s*:\\s*"
SPAN = 1024


def observed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text, body (without marker), seen (a feature code) and span, from conv_id, turn, text."""
    named = F.lower(F.regexp_extract("text", MARKER, 1))
    table = F.create_map(*(F.lit(x) for pair in MARKERS.items() for x in pair))
    marker = F.coalesce(F.try_element_at(table, named), F.lit("-"))
    text = F.coalesce("text", F.lit(""))
    size = F.least(F.lit(6), F.floor(F.log2(F.length(text) + 1) / 1.5)).cast("int")
    lines = F.least(F.lit(2), F.size(F.split(text, "\n")) - 1)
    place = F.when(F.col("turn") == 0, "first").when(F.col("turn") % 2 == 1, "odd").otherwise("even")
    rows = turns.withColumn("text", text).withColumn("__marker", marker)
    return rows.select(
        "*",
        F.when(F.col("__marker") == "-", F.col("text")).otherwise(F.regexp_replace("text", MARKER, "")).alias("body"),
        F.concat_ws("|", "__marker", size, lines, F.col("text").contains("?").cast("int"), place).alias("seen"),
        F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-1)).cast("long").alias("span"),
    ).drop("__marker")


@dataclass
class HiddenMarkov:
    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]
    unseen: np.ndarray

    def logs(self, seen: list[str]) -> np.ndarray:
        return np.stack([self.emit.get(s, self.unseen) for s in seen])

    def summary(self, logs: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each role before the span to each role at its end."""
        m = (np.repeat(self.start[None], len(self.roles), 0) if first else self.move) + logs[0]
        for row in logs[1:]:
            m = (m[:, :, None] + self.move[None]).max(axis=1) + row
        return m

    def decode(self, logs: np.ndarray, first: bool, before: int, last: int) -> list[int]:
        score, back = (self.start if first else self.move[before]) + logs[0], []
        for row in logs[1:]:
            step = score[:, None] + self.move
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        path = [last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def train(turns: DataFrame) -> HiddenMarkov:
    """From conv_id, turn, role, text with a non-null role; the counts are those of all rows, a table of roles by features."""
    rows = observed(turns).where("role is not null")
    before = F.lag("role").over(Window.partitionBy("conv_id", "span").orderBy("turn", "text"))
    table = rows.select("role", "seen", F.when(before.isNull() & (F.col("span") <= 0), F.lit("")).otherwise(before).alias("before"))
    moves = table.where("before is not null").groupBy("before", "role").count().toPandas()
    emits = table.groupBy("seen", "role").count().toPandas()
    roles = sorted(emits["role"].unique().tolist())
    at = {r: i for i, r in enumerate(roles)}
    n = len(roles)
    move, start = np.full((n, n), 0.5), np.full(n, 0.5)
    for r in moves.itertuples():
        if r.before == "":
            start[at[r.role]] += r.count
        elif r.before in at:
            move[at[r.before], at[r.role]] += r.count
    seen = sorted(emits["seen"].unique().tolist())
    counts = {s: np.full(n, 0.1) for s in seen}
    for s, r, c in emits.itertuples(index=False):
        counts[s][at[r]] += c
    total = sum(counts.values()) + 0.1 if n else np.zeros(0)
    return HiddenMarkov(roles, np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), {s: np.log(c / total) for s, c in counts.items()}, np.log(0.1 / total))


def _spans(batches):
    """Runs of rows of one (conv_id, span) from batches sorted by them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["conv_id"], held[0]["span"]) != (row["conv_id"], row["span"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def format_turns(turns: DataFrame, model: HiddenMarkov) -> DataFrame:
    """conv_id, turn, role_pred, rendered: a canonical turn ``<|role|>``, newline, text without marker, newline, ``<|end|>``.

    turns: conv_id, turn, text. Rows come in order of turn, then text; a null text is empty; a null conv_id is a
    conversation; a null turn stands before the others. Every row gets one row. Without roles role_pred is null.
    """
    spark = turns.sparkSession
    C.batches(spark)
    rows, _ = C.written(observed(C.pick(turns, conv_id="long", turn="long", text="string")).repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "turn", "text"), "observed")
    rows = rows.repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "turn", "text")
    if not model.roles:
        return rows.select("conv_id", "turn", F.lit(None).cast("string").alias("role_pred"), F.concat(F.lit("<||>\n"), "body", F.lit("\n<|end|>")).alias("rendered"))
    hmm = spark.sparkContext.broadcast(model)

    def sum_up(batches):
        for held in _spans(batches):
            m = hmm.value.summary(hmm.value.logs([r["seen"] for r in held]), False)
            f = hmm.value.summary(hmm.value.logs([r["seen"] for r in held]), True)
            yield pa.RecordBatch.from_pylist([{"conv_id": held[0]["conv_id"], "span": held[0]["span"], "m": m.ravel().tolist(), "f": f[0].tolist()}], schema=pa.schema([("conv_id", pa.int64()), ("span", pa.int64()), ("m", pa.list_(pa.float64())), ("f", pa.list_(pa.float64()))]))

    sums = rows.select("conv_id", "span", "seen").mapInArrow(sum_up, "conv_id long, span long, m array<double>, f array<double>")

    def link(frame):
        import pandas as pd

        frame = frame.sort_values("span")
        n = len(hmm.value.roles)
        score, back = np.array(frame.f.iloc[0]), []
        for m in frame.m.iloc[1:]:
            step = score[:, None] + np.array(m).reshape(n, n)
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pd.DataFrame({"conv_id": frame.conv_id, "span": frame.span, "before": [-1, *path[:-1]], "last": path})

    # a conversation of one span ends in its best role; only longer ones have to be linked
    longer = rows.groupBy("conv_id").agg(F.min("span").alias("lo"), F.max("span").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    linked = sums.join(longer, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").groupBy("conv_id").applyInPandas(link, "conv_id long, span long, before int, last int")
    cuts = linked.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "before", "last")
    ready = rows.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left").drop("c", "s").repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "turn", "text")

    def decode(batches):
        model = hmm.value
        for held in _spans(batches):
            logs = model.logs([r["seen"] for r in held])
            before, last = held[0]["before"], held[0]["last"]
            head = before is None or before < 0
            if last is None:
                last = int(model.summary(logs, True)[0].argmax())
            roles = [model.roles[i] for i in model.decode(logs, head, before if not head else 0, last)]
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([r["conv_id"] for r in held], pa.int64()), "turn": pa.array([r["turn"] for r in held], pa.int64()), "role_pred": pa.array(roles, pa.string()), "rendered": pa.array([f"<|{x}|>\n{r['body']}\n<|end|>" for x, r in zip(roles, held, strict=True)], pa.string())})

    return ready.mapInArrow(decode, "conv_id long, turn long, role_pred string, rendered string")


def op3(turns: DataFrame) -> DataFrame:
    """Learns from the conversations whose crc32(conv_id as text) mod 3 is not 1, formats all."""
    turns = C.pick(turns, conv_id="long", turn="long", role="string", text="string")
    model = train(turns.where(C.remainder("conv_id", 3) != 1))
    return format_turns(turns, model).withColumn("held_out", C.remainder("conv_id", 3) == 1).select("conv_id", "turn", "held_out", "role_pred", "rendered")
