"""Chat formatting: roles by a hidden Markov model, then canonical turns.

A conversation is a transcript of lines. A line shows a speaker marker (the row's
role on its first line, or a prefix such as "User:") or none, and features (length,
question, first of its row). Hidden states are the roles; starts, transitions and
the emissions of markers and features are counted over all rows whose role is
known, markers on top of ``PRIOR``. Viterbi finds the likeliest roles,
and each stretch of one role within a row is rendered as a turn.

Conversations are cut into blocks of ``BLOCK`` turn numbers, so that one of any
length spreads over tasks. A block's lines are a (max, +) matrix from the role
before it to the role at its end; the matrices of a conversation, a few numbers a
block, compose to the roles between blocks, and every block then finds its own
lines' roles between these.

Defined cases: rows that repeat a conversation, turn, role and text are one, with
the number of copies; rows that share a turn follow by role, then the hash of the text; rows without
a turn come first; a row without a conversation is one of its own; null and empty
texts are one empty line; unknown or null roles are found from lines and neighbours;
texts of any length are kept whole; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

ROLES = ["assistant", "system", "user"]
BLOCK = 64
# Words that name a speaker.
SPEAKERS = {
    "user": ["user", "human", "customer", "client", "prompter", "question"],
    "assistant": ["assistant", "ai", "bot", "agent", "model", "answer", "gpt"],
    "system": ["system", "instruction", "instructions", "context"],
}
_ROLE_OF = {w: ROLES.index(role) for role, words in SPEAKERS.items() for w in words}
_PREFIX = re.compile(r"^\s*(?:\*\*|\[|<\|?|#+\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*[:>]\s*", re.IGNORECASE)
NONE = -1
SHAPES = 8
#: What a marker counts before any is seen: that it names its role, or another.
PRIOR = 20.0, 0.001
LEAST = 1e-3
_BLANK = " \t\n\x0b\f\r"
KEYS = ["_conv", "_alone", "_block"]


def shape(line: str) -> int:
    """Length in four steps, and whether it asks."""
    n = len(line)
    return 2 * ((n >= 40) + (n >= 160) + (n >= 480)) + line.rstrip(_BLANK).endswith("?")


def observe(role: str | None, text: str | None) -> list[tuple[int, int, int, str]]:
    """(role of the row's marker, role of the line's marker, shape, line without its marker) of each line."""
    own, out = _ROLE_OF.get((role or "").strip().lower(), NONE), []
    for i, line in enumerate((text or "").split("\n")):
        found = _PREFIX.match(line)
        mark = _ROLE_OF[found[1].lower()] if found else NONE
        line = line[found.end() :] if found else line
        out.append((own if i == 0 else NONE, mark, shape(line), line))
    return out


class RoleModel:
    """Log probabilities: start (K), between rows (K x K), within a row (K x K), shapes (K x SHAPES), a row's and a line's marker (K x K)."""

    def __init__(self, starts: dict, moves: dict, shapes: dict, own: dict | None = None, marks: dict | None = None):
        k = len(ROLES)

        def logs(counts: np.ndarray) -> np.ndarray:
            p = (counts + 0.5) / (counts + 0.5).sum(axis=-1, keepdims=True)
            return np.log(np.maximum(p, LEAST))

        grid = np.zeros((k, k))
        for (a, b), n in moves.items():
            grid[a, b] = n
        seen = np.zeros((k, SHAPES))
        for (a, s), n in shapes.items():
            seen[a, s] = n
        self.start = logs(np.array([starts.get(a, 0) for a in range(k)], float))
        self.between, self.shapes = logs(grid), logs(seen)
        self.own, self.marks = (np.log(m / m.sum(axis=1, keepdims=True)) for m in (self._markers(own, k), self._markers(marks, k)))
        self.within = np.log(np.where(np.eye(k, dtype=bool), 1 - (k - 1) * LEAST, LEAST))

    @staticmethod
    def _markers(seen: dict | None, k: int) -> np.ndarray:
        out = np.where(np.eye(k, dtype=bool), *PRIOR)
        for (role, marker), n in (seen or {}).items():
            out[role, marker] += n
        return out

    def emission(self, own: int, mark: int, form: int) -> np.ndarray:
        out = self.shapes[:, form].copy()
        for m, seen in ((own, self.own), (mark, self.marks)):
            if m != NONE:
                out += seen[:, m]
        return out

    def steps(self, rows: list[list[tuple]], first: bool) -> list[np.ndarray]:
        """A matrix for each line, from the role before to its role. The first line of a conversation starts from any."""
        out = []
        for i, lines in enumerate(rows):
            for j, (own, mark, form, _) in enumerate(lines):
                move = self.within if j else self.between
                if first and i == 0 and j == 0:
                    move = np.tile(self.start, (len(ROLES), 1))
                out.append(move + self.emission(own, mark, form)[None, :])
        return out


def compose(steps: list[np.ndarray]) -> np.ndarray:
    """Best score from each role before to each role at the end."""
    total = steps[0]
    for s in steps[1:]:
        total = (total[:, :, None] + s[None, :, :]).max(axis=1)
    return total


def viterbi(steps: list[np.ndarray], entry: int, leave: int | None = None) -> list[int]:
    """The likeliest roles, from the role before to, if given, the role at the end. Ties go to the first role."""
    score, back = steps[0][entry], []
    for s in steps[1:]:
        both = score[:, None] + s
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    at = int(score.argmax()) if leave is None else leave
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, over the limits of batches."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append(row)
    if held:
        yield at, held


def prepared(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their conversation, block and the hash of their text."""
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    own = F.xxhash64("_turn", "_role", "_text")
    early = -1 - F.pmod(F.xxhash64("_role", "_text"), F.lit(64))
    block = F.when(F.col("_turn").isNull(), early).otherwise(F.floor(F.col("_turn") / BLOCK))
    return rows.withColumn("_alone", F.when(F.col("_conv").isNull(), own).otherwise(F.lit(0).cast("long"))).withColumn("_block", block.cast("long"))


def _known(role: Column) -> Column:
    """Number of the role that a word names, null if none."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(ROLES):
        out = F.when(F.lower(F.trim(role)).isin(SPEAKERS[name]), k).otherwise(out)
    return out


def learn(rows: DataFrame) -> RoleModel:
    """Counts over all rows with a known role: roles that start a conversation, moves from row to row, shapes and markers of lines."""
    known = rows.withColumn("_k", _known(F.col("_role")))
    n = F.length("_line")
    form = 2 * (F.when(n >= 40, 1).otherwise(0) + F.when(n >= 160, 1).otherwise(0) + F.when(n >= 480, 1).otherwise(0)) + F.col("_line").rlike(r"\?[ \t\n\x0b\f\r]*$").cast("int")
    lines = known.where("_k is not null").select("_k", F.explode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("_line"))
    mark = _known(F.regexp_extract("_line", "(?i)" + _PREFIX.pattern, 1))
    shapes, marks = {}, {}
    for k, shape_of, marked, count in lines.groupBy("_k", form.alias("_form"), mark.alias("_mark")).count().collect():  # roles x SHAPES x markers rows at most
        shapes[k, shape_of] = shapes.get((k, shape_of), 0) + count
        if marked is not None:
            marks[k, marked] = marks.get((k, marked), 0) + count
    ordered = F.array_sort(F.collect_list(F.struct("_turn", "_k")))
    once = known.select(*KEYS, "_turn", "_k", "_hash").distinct()
    blocks = checkpointed(once.groupBy(*KEYS).agg(ordered.alias("t")))  # at most BLOCK turn numbers
    inside = blocks.where("size(t) > 1").select(F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1]._k as a, t[i]._k as b))")).alias("p")).select("p.a", "p.b")
    ends = blocks.select(*KEYS, F.col("t")[0]["_k"].alias("b"), F.element_at("t", -1)["_k"].alias("_last"))
    order = Window.partitionBy(*KEYS[:2]).orderBy("_block")
    across = ends.select(F.lag("_last").over(order).alias("a"), "b", (F.row_number().over(order) == 1).alias("_opens"))
    pairs = inside.unionByName(across.where("not _opens").select("a", "b"))
    moves = {(r[0], r[1]): r[2] for r in pairs.where("a is not null and b is not null").groupBy("a", "b").count().collect()}
    starts = {r[0]: r[1] for r in across.where("_opens and b is not null").groupBy("b").count().collect()}
    own = {(r[0], r[0]): r[1] for r in known.where("_k is not null").groupBy("_k").count().collect()}
    return RoleModel(starts, moves, shapes, own, marks)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, n_lines, rendered, copies): the turns of every row, one for each stretch of lines of a role."""
    every = prepared(df, conv, turn, role, text)
    model = learn(every)
    names = [*KEYS, "_turn", "_role", "_hash", "_text"]
    rows = checkpointed(every.groupBy(*names).agg(F.count("*").alias("_copies")))
    kind = rows.schema["_conv"].dataType.simpleString()
    arrow = pa.schema([("_conv", rows.limit(0).toArrow().schema.field("_conv").type), ("_alone", pa.int64()), ("_block", pa.int64())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [[list(x[:3]) for x in observe(*r)] for r in zip(batch.column("_role").to_pylist(), batch.column("_text").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in names[:-1]] + [pa.array(seen, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, [*names[:-1], "_lines"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches, KEYS):
            observed = [[(*x, "") for x in r["_lines"]] for r in held]
            both = [compose(model.steps(observed, first)).ravel().tolist() for first in (True, False)]
            yield pa.RecordBatch.from_pylist([dict(zip(KEYS, key, strict=True)) | {"start": both[0], "go": both[1]}], arrow.append(pa.field("start", pa.list_(pa.float64()))).append(pa.field("go", pa.list_(pa.float64()))))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ROLES)
        for _, held in _groups(batches, KEYS[:2]):
            steps = [np.array(r["go" if i else "start"]).reshape(k, k) for i, r in enumerate(held)]
            path = viterbi(steps, 0)
            for a in range(0, len(held), 1024):
                some = [{**{c: r[c] for c in KEYS}, "_entry": path[i - 1] if i else 0, "_leave": path[i], "_opens": i == 0} for i, r in enumerate(held[a : a + 1024], a)]
                yield pa.RecordBatch.from_pylist(some, arrow.append(pa.field("_entry", pa.int32())).append(pa.field("_leave", pa.int32())).append(pa.field("_opens", pa.bool_())))

    ddl = f"_conv {kind}, _alone long, _block long, _turn long, _role string, _hash long, _lines array<array<int>>"
    dealt = rows.select(*names).mapInArrow(lines, ddl).repartition(*KEYS).sortWithinPartitions(*names[:-1])  # the texts stay where they are
    per_block = dealt.mapInArrow(matrices, f"_conv {kind}, _alone long, _block long, start array<double>, go array<double>")
    between = per_block.repartition(*KEYS[:2]).sortWithinPartitions(*KEYS).mapInArrow(ends, f"_conv {kind}, _alone long, _block long, _entry int, _leave int, _opens boolean")
    out = pa.schema([("_c", arrow.field("_conv").type), ("_t", pa.int64()), ("part", pa.int32()), ("_r", pa.string()), ("n_lines", pa.int32()), ("rendered", pa.string()), ("copies", pa.int64())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (head, *held) in _groups(batches, KEYS):
            observed = [observe(r["_role"], r["_text"]) for r in held]
            path, at, done = viterbi(model.steps(observed, head["_opens"]), head["_entry"], head["_leave"]), 0, []
            for row, lines in zip(held, observed, strict=True):
                roles = path[at : at + len(lines)]
                at += len(lines)
                cuts = [0, *(i for i in range(1, len(roles)) if roles[i] != roles[i - 1]), len(roles)]
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                    name = ROLES[roles[a]]
                    done.append({"_c": key[0], "_t": row["_turn"], "part": part, "_r": name, "n_lines": b - a, "rendered": turn_text(name, [x[3] for x in lines[a:b]]), "copies": row["_copies"]})
            yield pa.RecordBatch.from_pylist(done, out)

    # A block's ends are its first row, so that rows and ends meet in one exchange.
    heads = between.withColumn("_kind", F.lit(0))
    together = rows.withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    together = together.repartition(*KEYS).sortWithinPartitions(*KEYS, "_kind", *names[3:-1])
    done = together.mapInArrow(render, f"_c {kind}, _t long, part int, _r string, n_lines int, rendered string, copies long")
    return done.select(F.col("_c").alias(conv), F.col("_t").alias(turn), "part", F.col("_r").alias(role), "n_lines", "rendered", "copies")


def turn_text(role: str, lines: list[str]) -> str:
    """The canonical form of a turn: its role, its text without white space around it, and its end."""
    return f"<|{role}|>\n{'\n'.join(lines).strip()}\n<|end|>\n"
