"""Chat formatting: roles of the lines of a transcript by a hidden Markov model.

A transcript is text in which some lines begin with a speaker's marker, in
many styles, and some turns have none. Each line is seen as a symbol made of
its marker, whether a blank line is before it, and how it ends. The hidden
states are a role's first line or a later one; Viterbi finds the likeliest
states, and each turn is then rendered in one form.

A transcript may have any number of rows. Its rows are cut into blocks, and a
block acts on scores as a matrix under (max, +). Products of such matrices,
taken level by level over a bounded number of blocks, give each block the
states it is entered and left in, so a block is decoded by itself and the
result is that of one Viterbi pass over the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.tables import written

ROLES = ("system", "user", "assistant")
# Rows of a transcript in a block, and blocks that one product takes.
BLOCK_ROWS = 64
FAN = 1_024
# Blocks of labelled transcripts that the model is fitted on, at most.
TRAINING_BLOCKS = 2_000
STATES = 2 * len(ROLES)
START = STATES
_SPEAKERS = {
    "system": 0, "sys": 0, "context": 0, "instruction": 0, "instructions": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "me": 1, "customer": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "model": 2, "gpt": 2,
}
_MARKER = re.compile(
    r"^\s*(?:<\|(?P<tag>\w+)\|>|\[(?P<square>\w+)\]\s*:?|\#{1,4}\s*(?P<hash>\w+)\s*:?|\*\*(?P<bold>\w+)\s*:?\*\*\s*:?|(?P<plain>[\w.]{1,20})\s*:)\s*"
)
_OTHER, _NONE = 3, 4
SYMBOLS = 1 + 5 * 2 * 2


def marker(line: str) -> tuple[int, int]:
    """The kind of speaker a line's marker names (a role, other, or none) and where the text after it begins."""
    found = _MARKER.match(line)
    if found is None:
        return _NONE, 0
    name = next(g for g in found.groups() if g is not None)
    kind = _SPEAKERS.get(name.lower())
    if kind is None:
        # A word and a colon may be prose; only a name in brackets or the like is surely a speaker.
        return (_NONE, 0) if found["plain"] else (_OTHER, found.end())
    return kind, found.end()


def symbols(texts: list[str]) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Symbols of the lines of a transcript's rows, and (row, line number, line). A new row counts as after a blank line."""
    seen, lines = [], []
    for row, text in enumerate(texts):
        blank = True
        for number, line in enumerate(text.split("\n")):
            if not line.strip():
                seen.append(0)
                blank = True
            else:
                asks = line.rstrip().endswith("?")
                seen.append(1 + marker(line)[0] * 4 + 2 * blank + asks)
                blank = False
            lines.append((row, number, line))
    return seen, lines


@dataclass(frozen=True)
class Model:
    step: np.ndarray  # (STATES + 1) x STATES: log probabilities of the next state
    emit: np.ndarray  # STATES x SYMBOLS


def fitted(transitions: np.ndarray, emissions: np.ndarray) -> Model:
    """The model of counted transitions and emissions. A later line only follows a line of its role."""
    allowed = np.ones((STATES + 1, STATES), bool)
    for role in range(len(ROLES)):
        allowed[:, 2 * role + 1] = False
        allowed[2 * role : 2 * role + 2, 2 * role + 1] = True
    counts = np.where(allowed, transitions + 0.5, 0)
    with np.errstate(divide="ignore"):
        step = np.log(counts / counts.sum(1, keepdims=True))
    emit = np.log((emissions + 0.1) / (emissions + 0.1).sum(1, keepdims=True))
    return Model(step, emit)


def block_matrix(model: Model, seen: list[int]) -> np.ndarray:
    """The best score of a block's lines from each state before it to each state at its end."""
    total = None
    for symbol in seen:
        if total is None:
            total = model.step + model.emit[:, symbol]
        else:
            total = (total[:, :, None] + model.step[None, :STATES]).max(1) + model.emit[:, symbol]
    return total


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :STATES]).max(1)


def path(steps: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """The states after each step of the best path from ``entry``, to ``leave`` if given."""
    score = steps[0][entry]
    back = []
    for m in steps[1:]:
        through = score[:, None] + m[:STATES]
        back.append(through.argmax(0))
        score = through.max(0)
    state = int(score.argmax()) if leave is None else leave
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1]


def decode(model: Model, seen: list[int], entry: int = START, leave: int | None = None) -> list[int]:
    """States of a block's lines by Viterbi."""
    return path([model.step + model.emit[:, s] for s in seen], entry, leave)


def _with_blocks(rows: DataFrame) -> DataFrame:
    """(conv, seq, text, block): blocks of rows by their number in the transcript, from 0. Null texts are empty."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("seq").cast("long"), F.lit(0)) / BLOCK_ROWS).alias("block"),
        *(["role"] if "role" in rows.columns else []),
    )


def fit(rows: DataFrame) -> Model:
    """Fits the model on labelled rows (conv_id, seq, text, role), each row one turn.

    At most TRAINING_BLOCKS blocks are learned from, those of smallest hash;
    their counts are summed on the driver. Other roles than the known ones
    count as the user's. Without rows all allowed steps are equally likely.
    """
    blocks = _with_blocks(rows)
    chosen = blocks.select("conv", "block").distinct().orderBy(F.xxhash64("conv", "block"), "conv", "block").limit(TRAINING_BLOCKS)
    sample = blocks.join(F.broadcast(chosen), (blocks["conv"].eqNullSafe(chosen["conv"])) & (blocks["block"] == chosen["block"]), "left_semi")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("text", "ascending")])
        transitions, emissions = np.zeros((STATES + 1, STATES)), np.zeros((STATES, SYMBOLS))
        last = START if table["block"][0].as_py() == 0 else None
        seen, lines = symbols(table["text"].to_pylist())
        roles = [ROLES.index(r) if r in ROLES else 1 for r in table["role"].to_pylist()]
        for symbol, (row, number, _) in zip(seen, lines):
            state = 2 * roles[row] + (number > 0)
            if last is not None:
                transitions[last, state] += 1
            emissions[state, symbol] += 1
            last = state
        return pa.table({"t": pa.array([transitions.tobytes()]), "e": pa.array([emissions.tobytes()])})

    transitions, emissions = np.zeros((STATES + 1, STATES)), np.zeros((STATES, SYMBOLS))
    for r in sample.groupBy("conv", "block").applyInArrow(count, "t binary, e binary").toLocalIterator():
        transitions += np.frombuffer(r["t"]).reshape(transitions.shape)
        emissions += np.frombuffer(r["e"]).reshape(emissions.shape)
    return fitted(transitions, emissions)


def _matrix(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer()).reshape(STATES + 1, STATES)


def _sorted_group(table: pa.Table) -> pa.Table:
    return table.sort_by([("node", "ascending")])


def block_ends(matrices: DataFrame) -> DataFrame:
    """(conv, node, entry, leave) of each block from (conv, node, m), through products of at most FAN matrices at a time."""
    levels = [matrices]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) >= FAN:

        def combine(table: pa.Table) -> pa.Table:
            table = _sorted_group(table)
            total = None
            for value in table["m"]:
                total = _matrix(value) if total is None else product(total, _matrix(value))
            return pa.table({"conv": table["conv"][:1], "node": table["up"][:1], "m": pa.array([total.tobytes()])})

        below = levels[-1].withColumn("up", F.floor(F.col("node") / FAN))
        levels.append(written(below.groupBy("conv", "up").applyInArrow(combine, "conv bigint, node bigint, m binary"), "chat-products"))

    def ends(table: pa.Table) -> pa.Table:
        table = _sorted_group(table)
        entry, leave = table["entry"][0].as_py(), table["leave"][0].as_py()
        states = path([_matrix(v) for v in table["m"]], entry, leave)
        return pa.table({"conv": table["conv"], "node": table["node"], "entry": pa.array([entry, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32())})

    schema = "conv bigint, node bigint, entry int, leave int"
    known = None
    for level in reversed(levels):
        up = level.withColumn("up", F.floor(F.col("node") / FAN))
        if known is None:
            above = up.withColumns({"entry": F.lit(START), "leave": F.lit(None).cast("int")})
        else:
            parents = known.select(F.col("conv").alias("p"), F.col("node").alias("up"), "entry", "leave")
            above = up.join(parents, up["conv"].eqNullSafe(parents["p"]) & (up["up"] == parents["up"])).drop("p", parents["up"])
        known = above.groupBy("conv", "up").applyInArrow(ends, schema)
        known = written(known, "chat-ends")
    return known


def format_transcripts(rows: DataFrame, model: Model) -> DataFrame:
    """(conv_id, seq, line, role, starts, text, rendered): the turns recovered from (conv_id, seq, text).

    ``seq`` numbers a transcript's rows from 0; ``seq`` and ``line`` tell where
    a piece begins. A turn is one piece in each block it touches; ``starts``
    marks its first. Pieces in order, ``rendered`` one after another, are the
    transcript in one form: ``<|role|>`` on a line, the text, and so on. Markers
    and blank lines around a turn are dropped. A null text is empty, a null
    seq is 0, and rows that share one are ordered by text; a null conv_id is a
    transcript of its own. A transcript without any words gives turns with
    empty text; an empty table gives no rows. Other columns are ignored.
    """
    blocks = written(_with_blocks(rows.select("conv_id", "seq", "text")), "chat-rows")

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("text", "ascending")])
        seen, _ = symbols(table["text"].to_pylist())
        total = block_matrix(model, seen)
        return pa.table({"conv": table["conv"][:1], "node": table["block"][:1], "m": pa.array([total.tobytes()])})

    matrices = written(blocks.groupBy("conv", "block").applyInArrow(matrix, "conv bigint, node bigint, m binary"), "chat-blocks")
    ends = block_ends(matrices).withColumnRenamed("conv", "c")
    joined = blocks.join(ends, blocks["conv"].eqNullSafe(ends["c"]) & (blocks["block"] == ends["node"])).drop("c", "node")

    def turns(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("text", "ascending")])
        seen, lines = symbols(table["text"].to_pylist())
        states = decode(model, seen, table["entry"][0].as_py(), table["leave"][0].as_py())
        numbers = table["seq"].to_pylist()
        pieces: list[list] = []
        for state, (row, number, line) in zip(states, lines):
            first = state % 2 == 0
            if first or not pieces:
                pieces.append([numbers[row], number, ROLES[state // 2], first, []])
            pieces[-1][4].append(line[marker(line)[1] :] if first else line)
        texts = ["\n".join(p[4]).strip("\n") for p in pieces]
        rendered = [f"<|{p[2]}|>\n{t}\n" if p[3] else f"{t}\n" for p, t in zip(pieces, texts)]
        return pa.table(
            {
                "conv_id": pa.array([table["conv"][0].as_py()] * len(pieces), pa.int64()),
                "seq": pa.array([p[0] for p in pieces], pa.int64()),
                "line": pa.array([p[1] for p in pieces], pa.int32()),
                "role": pa.array([p[2] for p in pieces], pa.string()),
                "starts": pa.array([p[3] for p in pieces], pa.bool_()),
                "text": pa.array(texts, pa.string()),
                "rendered": pa.array(rendered, pa.string()),
            }
        )

    schema = "conv_id bigint, seq bigint, line int, role string, starts boolean, text string, rendered string"
    return joined.groupBy("conv", "block").applyInArrow(turns, schema)
