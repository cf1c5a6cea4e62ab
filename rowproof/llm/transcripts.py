"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A hidden state is a role and whether the line begins a turn. A line shows a speaker marker or none, whether it
follows an empty line, ends with a question mark, is short, is the first. Start, transition and
emission probabilities are counted (add-one) over all training conversations on the executors; the tables have
a fixed size. Viterbi decoding finds the likeliest states, and each turn is rendered as
``<|role|>`` + text. The rows of a conversation are numbered by (turn, role, text), and it is decoded in windows of
``WINDOW`` rows with ``OVERLAP`` rows of context at both sides; up to ``WINDOW`` rows that is plain Viterbi, and a
longer one never is one task, whatever its turns are.

Defined cases: null text is empty; a null turn counts as 0; a row without an id is a conversation of its own; rows
tied in turn, role and the first ``PREFIX`` characters follow a hash of the text; an unknown or null role trains
nothing and is rendered without a marker; rows equal in all four columns are one; without training rows all
probabilities are equal and ties go to the first state; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.operators.lookup import lookup
from rowproof.operators.ordering import number_rows

ROLES = ("user", "assistant", "system")
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
WINDOW, OVERLAP = 1024, 16
PREFIX = 256  # characters of a text in the order of rows: the sample that deals out ranges stays small
SHORT = 40
# Speaker names as transcripts write them.
NAMES = {
    "user": ("User", "Human", "You", "Customer"),
    "assistant": ("Assistant", "AI", "Bot", "Agent"),
    "system": ("System", "Instructions"),
}
_ROLE = {name.lower(): role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^(?:#+ ?|\*\*|\[)?(" + "|".join(_ROLE) + r")(?:\*\*|\])?:(?:\*\*)? ?", re.IGNORECASE)
FEATURES = ("marker", "after_empty", "question", "short", "first")


def transcript(conversation: object, turns: Sequence[tuple]) -> list[tuple[str, str | None, bool, int]]:
    """Lines as (text, true role, begins, index in ``turns``) of (turn, role, text): most turns with a speaker name, in
    several styles; every third, by a hash of its turn, without one."""
    lines = []
    for index, (turn, role, text) in enumerate(turns):
        choice = zlib.crc32(f"{conversation}:{turn}".encode())
        names = NAMES.get(role)
        head = ""
        if names and choice % 3:
            name = names[choice // 3 % len(names)]
            head = ("{}: ", "### {}: ", "**{}:** ", "[{}]: ")[choice // 64 % 4].format(name)
        if lines and choice // 256 % 2:
            lines.append(("", lines[-1][1], False, lines[-1][3]))
        for number, line in enumerate((head + (text or "")).split("\n")):
            lines.append((line, role if role in ROLES else None, number == 0, index))
    return lines


def observe(lines: Sequence[str]) -> list[tuple]:
    """What the model sees of each line."""
    seen = []
    for number, line in enumerate(lines):
        marker = _MARKER.match(line)
        seen.append(
            (
                _ROLE[marker[1].lower()] if marker else "",
                number > 0 and not lines[number - 1].strip(),
                line.rstrip().endswith("?"),
                len(line) < SHORT,
                number == 0,
            )
        )
    return seen


@dataclass
class RoleModel:
    start: list[float]
    step: list[list[float]]
    show: list[list[dict]]

    @classmethod
    def build(cls, counts: Counter) -> RoleModel:
        """From counts of ("start", state), ("step", state, state) and (feature number, state, value)."""
        size = range(len(STATES))
        values = [("", *ROLES)] + [(False, True)] * (len(FEATURES) - 1)

        def logs(keys: list[tuple]) -> list[float]:
            total = sum(counts[key] + 1 for key in keys)
            return [math.log((counts[key] + 1) / total) for key in keys]

        return cls(
            logs([("start", s, "") for s in size]),
            [logs([("step", s, str(t)) for t in size]) for s in size],
            [
                [dict(zip(options, logs([(str(f), s, str(v)) for v in options]))) for f, options in enumerate(values)]
                for s in size
            ],
        )

    def decode(self, seen: Sequence[tuple]) -> list[int]:
        """The likeliest states (Viterbi); ties go to the earlier state."""
        size, score, back = range(len(STATES)), [], []
        for number, line in enumerate(seen):
            here = [sum(table[value] for table, value in zip(self.show[s], line)) for s in size]
            if not number:
                score = [self.start[s] + here[s] for s in size]
                continue
            best = [max(size, key=lambda p, s=s: score[p] + self.step[p][s]) for s in size]
            score = [score[best[s]] + self.step[best[s]][s] + here[s] for s in size]
            back.append(best)
        if not score:
            return []
        path = [max(size, key=score.__getitem__)]
        for best in reversed(back):
            path.append(best[path[-1]])
        return path[::-1]


def _windows(conversations: DataFrame, id_column: str) -> DataFrame:
    """(_id, window, turns) with the turns of a window and its context, in order."""
    rows = conversations.select(
        F.col(f"`{id_column}`").alias("_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    turn = F.struct("turn", "role", "text")
    # without an id: a window of its own, in no group
    single = rows.where("_id IS NULL").select("_id", F.lit(0).cast("long").alias("window"), F.array(turn).alias("turns"))
    order = ["_id", "turn", "role", F.substring("text", 1, PREFIX), F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    numbered = number_rows(rows.where("_id IS NOT NULL"), order, "_place")
    sizes = numbered.groupBy("_id").agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    placed = lookup(numbered, sizes, "_id", weight="_rows", spread="_place")
    at = F.col("_place") - F.col("_start")
    own, place = F.floor(at / WINDOW), F.pmod(at, F.lit(WINDOW))
    near = F.array(
        own,
        F.when(place < OVERLAP, F.greatest(own - 1, F.lit(0))).otherwise(own),
        F.when((place >= WINDOW - OVERLAP) & ((own + 1) * WINDOW < F.col("_rows")), own + 1).otherwise(own),
    )
    dealt = placed.withColumn("window", F.explode(F.array_distinct(near)))
    grouped = dealt.groupBy("_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("_place", turn.alias("row")))).alias("turns")
    )
    return grouped.select("_id", "window", F.col("turns.row").alias("turns")).unionByName(single)


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in range(batch.num_rows):
            turns = [(t["turn"], t["role"], t["text"]) for t in batch.column("turns")[row].as_py()]
            conversation, window = batch.column("_id")[row].as_py(), batch.column("window")[row].as_py()
            yield conversation, window, transcript(conversation, turns)


def train(conversations: DataFrame, training: Column, id_column: str = "conv_id") -> RoleModel:
    """Count over all training conversations."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, _, lines in _rows(batches):
            before = None
            for (_, role, begins, _), seen in zip(lines, observe([line[0] for line in lines])):
                if role is None:
                    before = None
                    continue
                state = STATES.index((role, begins))
                if seen[-1]:
                    total["start", state, ""] += 1
                if before is not None:
                    total["step", before, str(state)] += 1
                total.update((str(f), state, str(value)) for f, value in enumerate(seen))
                before = state
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0] for key in keys], pa.string()),
                pa.array([key[1] for key in keys], pa.int32()),
                pa.array([key[2] for key in keys], pa.string()),
                pa.array([total[key] for key in keys], pa.int64()),
            ],
            ["kind", "state", "value", "n"],
        )

    rows = _windows(conversations.where(training), id_column)
    counted = rows.mapInArrow(count, "kind string, state int, value string, n long")
    summed = counted.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()  # a fixed number of kinds
    return RoleModel.build(Counter({(r["kind"], r["state"], r["value"]): r["n"] for r in summed}))


def format_chats(conversations: DataFrame, model: RoleModel, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation and window: id, window, n_lines, n_turns, n_right (lines whose role was
    recovered), roles and the canonical text; conversations of up to ``WINDOW`` rows have one row."""
    shared = conversations.sparkSession.sparkContext.broadcast(model)
    kind = conversations.schema[id_column].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for _, window, lines in _rows(iter([batch])):
                states = shared.value.decode(observe([line[0] for line in lines]))
                roles, texts, right, many = [], [], 0, 0
                # a window holds consecutive rows, context first
                start = max(0, window * WINDOW - OVERLAP)
                for (line, role, _, index), state in zip(lines, states):
                    if (start + index) // WINDOW != window:
                        continue
                    found, begins = STATES[state]
                    many += 1
                    right += found == role
                    if begins or not roles:
                        roles.append(found)
                        texts.append([_MARKER.sub("", line, count=1)])
                    else:
                        texts[-1].append(line)
                rendered = "".join(f"<|{role}|>\n{'\n'.join(text).strip()}\n" for role, text in zip(roles, texts))
                for held, value in zip(out, (window, many, len(roles), right, ",".join(roles), rendered)):
                    held.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(v, t) for v, t in zip(out, types)]],
                [id_column, "window", "n_lines", "n_turns", "n_right", "roles", "rendered"],
            )

    return _windows(conversations, id_column).mapInArrow(
        render,
        f"`{id_column}` {kind}, window long, n_lines long, n_turns long, n_right long, roles string, rendered string",
    )
