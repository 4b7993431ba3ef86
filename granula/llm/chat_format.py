"""Chat formatting: a hidden Markov model over speaker markers and line features, Viterbi, canonical rendering.

A transcript is a sequence of given turns, each a text of one or more lines. Every line emits one symbol: the speaker marker at
its start (none, user, assistant or system), its length class, whether it opens a given turn, and whether it asks. A line that
opens a given turn or bears a marker may begin a new speaker's turn (`move`); other lines mostly go on (`stay`). Initial,
transition and emission counts come from labelled conversations outside a held-out fold, with pseudo-counts, larger where marker
and role agree. So a given turn that holds several speakers' lines is parted among them, and one transcript pasted as a single
text is parsed like a conversation.

Viterbi runs exactly and in parallel over blocks of turns: a block becomes a max-plus matrix (best score from every entry role to
every exit role), the matrices of a conversation fix the roles at block borders, and each block is then solved between its fixed
ends. So a conversation of any length is never in one task whole; only its 3 x 3 matrices meet.

A recovered turn is a run of lines of one role, broken at markers; it is rendered as <|role|>, a line break, its lines without
the marker, and <|end|>.

Defined results: turns follow by (turn, text hash); repeated turns are kept in that order; a row whose conv_id or turn is null
is a conversation of its own; a null text counts as empty, an empty text is one empty line; a very long text is one item of its
block; unknown or null given roles are not learned from; ties, as without any usable label, go to the first of ROLES. An empty
table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The roles and the markers that transcripts use for them.
ROLES = ["system", "user", "assistant"]
MARKERS = {"user": "user|human|customer|question|q", "assistant": "assistant|ai|bot|model|answer|a", "system": "system|instructions?"}
LENGTHS = [60, 120, 200, 300, 420, 600, 900]
BLOCK = 256
N_SYMBOLS = 4 * (len(LENGTHS) + 1) * 2 * 2
#: Pseudo-counts of a symbol, and of one whose marker names the role.
LEAST, AGREED = 0.1, 5.0


def marker_pattern(names: str) -> str:
    return rf"(?i)^\s*(?:<\|(?:{names})\|>|\[(?:{names})\]|#+\s*(?:{names})\s*:?(?=\s)|(?:\*\*)?(?:{names})(?:\*\*)?\s*:)\s*"


def symbols(text: Column) -> Column:
    """The symbol of every line of a given turn, ints below N_SYMBOLS; native expressions."""

    def one(line: Column, i: Column) -> Column:
        mark = F.lit(0)
        for n, role in enumerate(("user", "assistant", "system"), 1):
            mark = F.when(line.rlike(marker_pattern(MARKERS[role])), n).otherwise(mark)
        long = sum(((F.length(line) > n).cast("int") for n in LENGTHS), F.lit(0))
        return (((mark * (len(LENGTHS) + 1) + long) * 2 + F.rtrim(line).endswith("?").cast("int")) * 2 + (i == 0).cast("int")).cast("int")

    return F.transform(F.split(text, "\n"), one)


def marker_of(symbol: int) -> int:
    return symbol // (4 * (len(LENGTHS) + 1))


def may_begin(symbol: int) -> bool:
    """Whether a line may begin a new speaker's turn."""
    return bool(symbol & 1 or marker_of(symbol))


def without_marker(text: Column) -> Column:
    return F.regexp_replace(text, marker_pattern("|".join(MARKERS.values())), "")


def begins(symbol: Column, path: Column, i: Column) -> Column:
    """Whether line i begins a recovered turn: the role changes, or a marker stands there."""
    return (i == 0) | (F.get(path, i) != F.get(path, i - 1)) | (F.get(symbol, i) >= 4 * (len(LENGTHS) + 1))


def render(text: Column, symbol: Column, path: Column) -> Column:
    """Every recovered turn as <|role|>, a line break, its lines, <|end|>; turns are parted by line breaks."""
    role = F.array(*map(F.lit, ROLES))

    def piece(line: Column, i: Column) -> Column:
        opened = F.concat(F.when(i > 0, F.lit("<|end|>\n")).otherwise(F.lit("")), F.lit("<|"), F.get(role, F.get(path, i)), F.lit("|>\n"), without_marker(line))
        return F.when(begins(symbol, path, i), opened).otherwise(F.concat(F.lit("\n"), line))

    return F.concat(F.concat_ws("", F.transform(F.split(text, "\n"), piece)), F.lit("<|end|>"))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    stay: np.ndarray | None = None

    def into(self, symbol: int) -> np.ndarray:
        """The transition into a line: between turns, or inside one."""
        return self.move if self.stay is None or may_begin(symbol) else self.stay

    def block_matrix(self, symbols: list[int]) -> np.ndarray:
        """[entry, exit]: best log score of the block after its first line's role is fixed; the first emission included."""
        best = np.where(np.eye(3, dtype=bool), self.emit[:, symbols[0]][:, None], -np.inf)
        for s in symbols[1:]:
            best = (best[:, :, None] + self.into(s)[None]).max(axis=1) + self.emit[:, s]
        return best

    def path(self, symbols: list[int], entry: int | None = None, exit_: int | None = None) -> list[int]:
        score = self.start + self.emit[:, symbols[0]] if entry is None else np.where(np.arange(3) == entry, self.emit[:, symbols[0]], -np.inf)
        back = []
        for s in symbols[1:]:
            step = score[:, None] + self.into(s)
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + self.emit[:, s]
        at = int(score.argmax()) if exit_ is None else exit_
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]

    def borders(self, blocks: list[np.ndarray]) -> list[tuple[int, int]]:
        """(entry, exit) role of every block on the best path; a block begins with a line that may begin a turn."""
        reach, choice = self.start[:, None] + blocks[0], []
        score = reach.max(axis=0)
        choice.append((None, reach.argmax(axis=0)))
        for m in blocks[1:]:
            into = (score[:, None] + self.move).max(axis=0)
            source = (score[:, None] + self.move).argmax(axis=0)
            reach = into[:, None] + m
            choice.append((source, reach.argmax(axis=0)))
            score = reach.max(axis=0)
        at, out = int(score.argmax()), []
        for source, entry in reversed(choice):
            e = int(entry[at])
            out.append((e, at))
            at = int(source[e]) if source is not None else at
        return out[::-1]

    def turns(self, rows: list[list[int]], entry: int | None = None, exit_: int | None = None) -> list[list[int]]:
        """The role of every line of consecutive given turns."""
        flat, out, at = self.path([s for r in rows for s in r], entry, exit_), [], 0
        for r in rows:
            out.append(flat[at : at + len(r)])
            at += len(r)
        return out


def prepared(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, symbols, block, and whether the row is a conversation of its own."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    return rows.withColumn("alone", F.col("conv_id").isNull() | F.col("turn").isNull()).withColumn("block", F.floor(F.col("turn") / BLOCK).cast("long")).withColumn("symbols", symbols(F.col("text")))


def fit(conversations: DataFrame, folds: int = 5, held: int = 0) -> Hmm:
    """Counts over all labelled conversations outside the fold; at most a few thousand sums reach the driver. Pairs over a block border are left out."""
    known = prepared(conversations).where(~F.col("alone") & F.col("role").isin(ROLES) & (F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds != held))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", F.xxhash64("text"))
    rows = known.select("block", "role", "symbols", F.lag("role").over(order).alias("before")).select("role", "before", (F.col("block") == 0).alias("opening"), F.explode("symbols").alias("symbol"))
    start, move, stay = np.ones(3), np.ones((3, 3)), np.ones((3, 3))
    emit = np.array([[AGREED if marker_of(s) and ("user", "assistant", "system")[marker_of(s) - 1] == role else LEAST for s in range(N_SYMBOLS)] for role in ROLES])
    for r in rows.groupBy("role", "symbol", "before", "opening").count().collect():
        i = ROLES.index(r.role)
        emit[i, r.symbol] += r["count"]
        if not r.symbol & 1:
            stay[i, i] += 0 if marker_of(r.symbol) else r["count"]
        elif r.before is not None:
            move[ROLES.index(r.before), i] += r["count"]
        elif r.opening:
            start[i] += r["count"]
    return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True)), np.log(stay / stay.sum(axis=1, keepdims=True)))


def parse(conversations: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn, role (as given), parsed_role (of the first line), n_turns (recovered in it), rendered: a row for every row."""
    rows = prepared(conversations)
    item = F.struct("turn", F.xxhash64("text").alias("h"), "symbols", "role", "text", "conv_id")
    blocks = rows.where("not alone").groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    emitted = blocks.select("conv_id", "block", F.transform("turns", lambda t: t["symbols"]).alias("symbols"))
    roles = pa.list_(pa.list_(pa.int32()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [model.block_matrix([x for r in s for x in r]).ravel().tolist() for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.float64()))], names=["conv_id", "block", "m"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"block": x["block"], "entry": e, "exit": o} for x, (e, o) in zip(seq, model.borders([np.array(x["m"]).reshape(3, 3) for x in seq]), strict=True)] for seq in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])))], names=["conv_id", "fixed"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.turns([t["symbols"] for t in turns], e, o) for turns, e, o in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, roles)], names=["turns", "path"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.path(s) for s in b.column(4).to_pylist()], pa.list_(pa.int32()))], names=[*names, "path"])

    per = emitted.mapInArrow(matrices, "conv_id bigint, block bigint, m array<double>")
    fixed = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("seq")).mapInArrow(ends, "conv_id bigint, fixed array<struct<block: bigint, entry: int, exit: int>>")
    borders = fixed.select("conv_id", F.explode("fixed").alias("f")).select("conv_id", "f.block", "f.entry", "f.exit")
    turns_type = blocks.schema["turns"].dataType.simpleString()
    solved = blocks.join(borders, ["conv_id", "block"]).select("turns", "entry", "exit").mapInArrow(paths, f"turns {turns_type}, path array<array<int>>")
    names = ["conv_id", "turn", "role", "text", "symbols"]
    flat = solved.select(F.explode(F.arrays_zip("turns", "path")).alias("x")).select(*[f"x.turns.{c}" for c in names], "x.path")
    own = rows.where("alone").select(*names)
    every = flat.union(own.mapInArrow(single, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", path array<int>"))
    symbol, path = F.col("symbols"), F.col("path")
    count = F.size(F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: begins(symbol, path, i)))
    return every.select("conv_id", "turn", "role", F.get(F.array(*map(F.lit, ROLES)), F.get(path, F.lit(0))).alias("parsed_role"), count.cast("long").alias("n_turns"), render(F.col("text"), symbol, path).alias("rendered"))


def op9_hmm_transcripts(conversations: DataFrame) -> DataFrame:
    """Every turn: the role recovered from its text, whether its conversation was held out (crc32(conv_id) mod 5 = 0), and its rendering's MD5."""
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return parse(conversations, fit(conversations)).select("conv_id", "turn", "role", "parsed_role", "n_turns", held.alias("held_out"), F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"))
