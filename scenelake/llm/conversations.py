"""Repair of conversations by cheapest edits: parallel Viterbi by rank convergence, then tracing of the least audit.

A repaired conversation is empty or is an optional system turn and then user and assistant turns in pairs. Rows are kept
(0), given the role their place needs (1), deleted (2; blank rows and repeats must be), and empty turns are put in (5);
a truncated row that stays costs 5 more. Costs run backwards over four states: nothing yet, after a system, a user, an
assistant turn.

All rows are sorted over the cluster by conversation and place, and each task cuts its rows into chunks of bounded size.
Most conversations are one chunk and are solved there. A conversation that spans tasks or is long is solved in parallel:
every chunk runs backwards from a guessed cost vector; then, as long as the vector that a chunk started from is not what
the chunk behind it came to (vectors that differ by a constant are the same), it starts again and stops where both runs
are the same. Chunks whose rows never let the guess fade (only roles that fit nowhere) are settled after a few passes by
the 4 by 4 table of costs from state to state. With exact vectors each chunk is traced forwards from its four possible
states; the states are strung together per conversation, and each chunk writes its part of audit and text.

Defined results: a null conv_id is one conversation; null roles and texts count as one space, as do nulls in the damage's
key; rows of one turn are ordered by role, then by SHA-256 of the text, equal rows standing together; roles that begin
with none of s, u, a fit nowhere; gaps overlook null turns; conversations without rows after damage have zeros and empty
results; an empty table gives no rows; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.tables import scratch, stored

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text in a chunk.
ROWS, BYTES = 1 << 16, 1 << 20
#: Passes of parallel mending before tables of costs settle the rest.
PASSES = 6
_BLANK = r"^[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Kinds of rows: 0 must go, 1 to 4 begin with s, u, a
# or anything else, 5 to 8 are these truncated.
Vector = tuple[int, int, int, int]
_INSERTED = (2, 2, 3, 2)
_ROLE = ("", "system", "user", "assistant")
_KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}
_KIND = {"s": 1, "u": 2, "a": 3}
#: Costs of what is left to put in at a conversation's end.
FINAL: Vector = (0, 10, 5, 0)
GUESS: Vector = (0, 0, 0, 0)
_FAR = 1000


def _options(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in the letters' order but for insertion."""
    late = TRUNCATED if kind > 4 else 0
    base = (kind - 1) % 4 + 1 if kind else 0
    found = [("D", DELETE, state)]
    if base and (state, base) in _KEPT:
        found.append(("K", late, _KEPT[state, base]))
    if base:
        found.append(("R", RENAME + late, _INSERTED[state]))
    return found


class Costs:
    """Steps over one row, remembered: vectors are kept with their least entry at zero, so that few exist."""

    def __init__(self) -> None:
        self.backs: dict[tuple[int, Vector], tuple[Vector, int]] = {}
        self.forths: dict[tuple[int, Vector, int], tuple[str, int, tuple[int, ...], int, int]] = {}

    @staticmethod
    def whole(kind: int, after: Vector) -> list[int]:
        """Cost from each state before a row, given the costs after it."""
        act = [min(cost + after[to] for _, cost, to in _options(kind, state)) for state in range(4)]
        two, three = min(act[2], INSERT + act[3]), min(act[3], INSERT + act[2])
        return [min(act[0], INSERT + two), min(act[1], INSERT + two), two, three]

    def back(self, kind: int, after: Vector) -> tuple[Vector, int]:
        """The vector before a row, and what was taken off."""
        known = self.backs.get((kind, after))
        if known is None:
            costs = self.whole(kind, after)
            low = min(costs)
            known = self.backs[kind, after] = (tuple(c - low for c in costs), low)
        return known

    def forth(self, kind: int, after: Vector, state: int) -> tuple[str, int, tuple[int, ...], int, int]:
        """The least letters for a row, the state after it, the states put in before it, whether it stays (its role's state, or 0) and its cost."""
        known = self.forths.get((kind, after, state))
        if known is None:
            costs, letters, put, spent, at = self.whole(kind, after), "", [], 0, state
            while True:
                options = {letter: (cost, to) for letter, cost, to in _options(kind, at)}
                best = next((x for x in ("D", "I", "K", "R") if (x == "I" and INSERT + costs[_INSERTED[at]] == costs[at]) or (x in options and options[x][0] + after[options[x][1]] == costs[at])))
                letters += best
                if best != "I":
                    cost, to = options[best]
                    stays = 0 if best == "D" else -1 if best == "K" else to
                    known = (letters, to, tuple(put), stays, spent + cost)
                    break
                at = _INSERTED[at]
                put.append(at)
                spent += INSERT
            self.forths[kind, after, state] = known
        return known

    def run(self, tokens: bytes, after: Vector, old: Vector | None = None, old_start: Vector | None = None) -> Vector:
        """The vector at a chunk's start. With an earlier run's end and start, it stops where both runs are the same."""
        back = self.back
        for kind in reversed(tokens):
            if kind:
                after = back(kind, after)[0]
                if old is not None:
                    old = back(kind, old)[0]
                    if old == after:
                        return old_start
        return after

    def table(self, tokens: bytes) -> list[int]:
        """Costs from each state before a chunk to each state after it, row by row; what cannot be is far."""
        columns = []
        for to in range(4):
            vector, total = tuple(0 if state == to else _FAR for state in range(4)), 0
            for kind in reversed(tokens):
                if kind:
                    vector, low = self.back(kind, vector)
                    total += low
            columns.append([value + total for value in vector])
        return [columns[to][state] for state in range(4) for to in range(4)]

    def vectors(self, tokens: bytes, after: Vector) -> list[Vector]:
        """The vector after each row."""
        found = [after] * len(tokens)
        back = self.back
        for at in range(len(tokens) - 1, -1, -1):
            found[at] = after
            if tokens[at]:
                after = back(tokens[at], after)[0]
        return found

    def end(self, tokens: bytes, vectors: list[Vector], state: int) -> int:
        """Where a trace from ``state`` ends."""
        for kind, after in zip(tokens, vectors, strict=True):
            if kind:
                state = self.forth(kind, after, state)[1]
        return state

    def trace(self, tokens: bytes, vectors: list[Vector], state: int, roles: list[str], texts: list[str]) -> tuple[str, list[str], int, int]:
        """Audit, repaired lines, cost and last state of a chunk; roles and texts are those of rows that may stay."""
        audit, lines, total, at = [], [], 0, 0
        for kind, after in zip(tokens, vectors, strict=True):
            if not kind:
                audit.append("D")
                total += DELETE
                continue
            letters, state, put, stays, cost = self.forth(kind, after, state)
            audit.append(letters)
            total += cost
            lines += [f"{_ROLE[role]}:" for role in put]
            if stays:
                lines.append(f"{roles[at] if stays < 0 else _ROLE[stays]}:{texts[at]}")
            at += 1
        return "".join(audit), lines, total, state


def _ending(state: int) -> tuple[str, list[str], int]:
    """What is put in at a conversation's end."""
    put = {1: [2, 3], 2: [3]}.get(state, [])
    return "I" * len(put), [f"{_ROLE[role]}:" for role in put], INSERT * len(put)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage with their number of adjacent copies (0: dropped), equal rows of a task's batch in one.

    conv_id, turn, place_role and place (what rows of a turn are ordered by), role, text, copies.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = pa.Table.from_batches([batch]).group_by(["conv_id", "turn", "role", "text"]).aggregate([("copies", "sum")])
            yield from merged.rename_columns([*merged.column_names[:4], "copies"]).select(["conv_id", "turn", "role", "text", "copies"]).combine_chunks().to_batches()

    blank = F.lit(" ")
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                      F.coalesce(F.col("text").cast("string"), blank).alias("text"), F.lit(1).cast("long").alias("copies"))
    own = own.mapInArrow(collapse, "conv_id long, turn long, role string, text string, copies long")
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), blank) for name in ("conv_id", "turn")))
    own = own.select("*", (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.col("role").alias("place_role"), F.unhex(F.sha2("text", 256)).alias("place"),
                      F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("harm") != 0, text).alias("text"),
                      (F.col("copies") * F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)).alias("copies"))


_PLACE = ["conv_id", "turn", "place_role", "place"]
_CHUNK = ("conv_id long, part long, seq long, alone boolean, tokens binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, "
          "illegal long, first string, last string, least_turn long, most_turn long, turns long")


class _Chunk:
    """Rows of one conversation in a task, until they are written."""

    def __init__(self, conv: int | None, seq: int) -> None:
        self.conv, self.seq, self.size = conv, seq, 0
        self.tokens, self.roles, self.texts = bytearray(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least_turn = self.most_turn = None

    def add(self, turn: int | None, role: str, copies: int, kind: int, text: str, fault: str) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.illegal += copies - 1
        if turn is not None and turn != self.most_turn:
            self.turns += 1
            self.most_turn = turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
        if kind:
            self.tokens.append(kind)
            self.tokens += bytes(copies - 1)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text) + len(role)
            self.duplicate += copies - 1
            self.truncated += kind > 4
        else:
            self.tokens += bytes(copies)
            setattr(self, fault, getattr(self, fault) + copies)

    def row(self, part: int, alone: bool) -> tuple:
        return (self.conv, part, self.seq, alone, bytes(self.tokens), self.roles, self.texts, self.blank, self.duplicate, self.truncated, self.illegal,
                self.first, self.last, self.least_turn, self.most_turn, self.turns)


def _cut(rows: int, size: int):
    """Cuts sorted rows into chunks of about ``rows`` rows and ``size`` characters."""
    names = [field.split()[0] for field in _CHUNK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first_conv = TaskContext.get().partitionId(), None, True
        done: list[tuple] = []
        held = 0
        later = row = None  # the marker met last; the row met last with its copies so far

        def place(item: tuple) -> None:
            nonlocal chunk, first_conv, held
            conv, turn, role, text, copies, is_later, blank, ended = item
            if chunk is None or chunk.conv != conv:
                if chunk is not None:
                    held += chunk.size + len(chunk.tokens)
                    done.append(chunk.row(part, chunk.seq == 0 and not first_conv))
                    first_conv = False
                chunk = _Chunk(conv, 0)
            kind = 0 if blank or is_later else _KIND.get(role[:1], 4) + (0 if ended else 4)
            fault = "blank" if blank else "duplicate"
            while copies:
                if len(chunk.tokens) >= rows or chunk.size >= size:
                    held += chunk.size + len(chunk.tokens)
                    done.append(chunk.row(part, False))
                    chunk = _Chunk(conv, chunk.seq + 1)
                some = min(copies, max(rows - len(chunk.tokens), 1))
                chunk.add(turn, role, some, kind, text, fault)
                copies, kind, fault = copies - some, 0, "blank" if blank else "duplicate"

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for *own, marker, role, text, copies, blank, ended in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if marker:
                    later = own
                    continue
                if row is not None and row[0] == own:
                    row[1][4] += copies
                    continue
                if row is not None:
                    place(row[1])
                row = (own, [own[0], own[1], role, text, copies, later == own, blank, ended])
            if held >= 4 * size or len(done) >= rows // 16:
                yield batch_of()
                done, held = [], 0
        if row is not None:
            place(row[1])
            done.append(chunk.row(part, False))
        if done:
            yield batch_of()

    return run


def chunks(rows: DataFrame, folder: str, size: int = ROWS, characters: int = BYTES) -> DataFrame:
    """Damaged conversations in chunks, stored: tokens of all rows, roles and texts of those that may stay, and counts."""
    spark = rows.sparkSession
    harmed = damaged(rows)
    keys = harmed.where((F.col("copies") > 0) & ~F.col("text").rlike(_BLANK)).select(*_PLACE, "role", F.unhex(F.sha2("text", 256)).alias("content"))
    keys = stored(keys, f"{folder}/keys")
    order = F.struct("turn", "place_role", "place")
    first = keys.groupBy("conv_id", "role", "content").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low != high")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "content", "low")
    # Few contents come twice; where many do, the join's hot keys are split.
    again = keys.join(first, (keys["conv_id"].eqNullSafe(first["c"])) & (keys["role"] == first["r"]) & (keys["content"] == first["content"]))
    markers = stored(again.where(F.struct("turn", "place_role", "place") != F.col("low")).select(*_PLACE), f"{folder}/markers")

    own = harmed.select(*_PLACE, F.lit(0).alias("marker"), "role", "text", "copies", F.coalesce(F.col("text").rlike(_BLANK), F.lit(True)).alias("blank"),
                        F.coalesce(F.col("text").rlike(_ENDED), F.lit(False)).alias("ended"))
    signs = markers.select(*_PLACE, F.lit(-1).alias("marker"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("ended"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(signs).repartitionByRange(tasks, *_PLACE).sortWithinPartitions(*_PLACE, "marker")
    dealt = dealt.select(*_PLACE, (F.col("marker") < 0).alias("marker"), "role", "text", "copies", "blank", "ended")
    return stored(dealt.mapInArrow(_cut(size, characters), _CHUNK), f"{folder}/chunks")


_ID = ["conv_id", "part", "seq"]
_VECTORS = "conv_id long, part long, seq long, used array<int>, start array<int>, moved boolean"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs chunks backwards from ``wanted``, unless they already ran from it."""
    costs = Costs()
    for batch in batches:
        rows = []
        for conv, part, seq, tokens, wanted, used, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            end = tuple(wanted)
            if used is None:
                new = costs.run(tokens, end)
            elif tuple(used) == end:
                new = tuple(start)
            else:
                new = costs.run(tokens, end, tuple(used), tuple(start))
            rows.append((conv, part, seq, end, new, start is None or tuple(start) != new))
        yield _batch(rows, _VECTORS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [field.rsplit(" ", 1) for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def settled(open_: DataFrame, folder: str, passes: int = PASSES) -> DataFrame:
    """conv_id, part, seq and the exact vector (to a constant) at the end of each stored chunk that holds rows which may stay."""
    after = Window.partitionBy("conv_id").orderBy("part", "seq")
    real = open_.withColumn("next", F.lead(F.struct("part", "seq")).over(after))
    real = stored(real, f"{folder}/real")
    final = F.array(*map(F.lit, FINAL))
    none = F.lit(None).cast("array<int>")
    vectors = stored(real.select(*_ID, "tokens", F.when(F.col("next").isNull(), final).otherwise(F.array(*map(F.lit, GUESS))).alias("wanted"), none.alias("used"), none.alias("start"))
                     .mapInArrow(_run, _VECTORS), f"{folder}/vectors0")
    for turn in range(1, passes + 1):
        vectors = stored(_wanted(real, vectors, final).mapInArrow(_run, _VECTORS), f"{folder}/vectors{turn}")
        if vectors.where("moved").isEmpty():
            return vectors.select(*_ID, F.col("used").alias("after"))
    return _by_tables(real, folder)


def _wanted(real: DataFrame, vectors: DataFrame, final) -> DataFrame:
    """Chunks with the vector that the chunk behind them came to, and their own last run."""
    ahead = vectors.select(F.col("conv_id").alias("c"), F.struct("part", "seq").alias("at"), F.col("start").alias("there"))
    own = real.join(vectors.select(F.col("conv_id").alias("c0"), F.col("part").alias("p0"), F.col("seq").alias("s0"), "used", "start"),
                    F.col("conv_id").eqNullSafe(F.col("c0")) & (F.col("part") == F.col("p0")) & (F.col("seq") == F.col("s0")))
    joined = own.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("next") == F.col("at")), "left")
    return joined.select(*_ID, "tokens", F.when(F.col("next").isNull(), final).otherwise(F.col("there")).alias("wanted"), "used", "start")


def _by_tables(real: DataFrame, folder: str) -> DataFrame:
    """The same by tables of costs from state to state: made per chunk, strung together per conversation (sixteen numbers a chunk)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            yield _batch([(conv, part, seq, costs.table(tokens)) for conv, part, seq, tokens in zip(*(column.to_pylist() for column in batch.columns), strict=True)],
                         "conv_id long, part long, seq long, costs array<int>")

    def string(table: pa.Table) -> pa.Table:
        rows, after, out = sorted(table.to_pylist(), key=lambda row: (row["part"], row["seq"]), reverse=True), FINAL, []
        for row in rows:
            out.append((row["conv_id"], row["part"], row["seq"], after))
            costs = [min(row["costs"][4 * state + to] + after[to] for to in range(4)) for state in range(4)]
            after = tuple(cost - min(costs) for cost in costs)
        return pa.Table.from_batches([_batch(out, "conv_id long, part long, seq long, after array<int>")])

    tables = stored(real.select(*_ID, "tokens").mapInArrow(make, "conv_id long, part long, seq long, costs array<int>"), f"{folder}/tables")
    return tables.groupBy("conv_id").applyInArrow(string, "conv_id long, part long, seq long, after array<int>")


def _started(ends: DataFrame) -> DataFrame:
    """conv_id, part, seq and the state that each chunk starts in, from the states that it leads to."""

    def string(table: pa.Table) -> pa.Table:
        state, out = 0, []
        for row in sorted(table.to_pylist(), key=lambda row: (row["part"], row["seq"])):
            out.append((row["conv_id"], row["part"], row["seq"], state))
            state = row["ends"][state]
        return pa.Table.from_batches([_batch(out, "conv_id long, part long, seq long, state int")])

    return ends.groupBy("conv_id").applyInArrow(string, "conv_id long, part long, seq long, state int")


_PIECE = ("conv_id long, part long, seq long, state int, audit string, repaired string, cost long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, least_turn long, most_turn long, turns long")
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "first", "last", "least_turn", "most_turn", "turns"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Traces chunks from their state, with the vector at their end."""
    costs = Costs()
    for batch in batches:
        rows = []
        for conv, part, seq, tokens, roles, texts, after, state, *counts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            audit, lines, total, state = costs.trace(tokens, costs.vectors(tokens, tuple(after)), state, roles, texts)
            rows.append((conv, part, seq, state, audit, "\n".join(lines) if lines else None, total, *counts))
        yield _batch(rows, _PIECE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations from their pieces in order; the text runs through the digest piece by piece."""
    held: dict | None = None

    def close() -> tuple:
        audit, lines, cost = _ending(held["state"])
        for line in lines:
            held["lines"].update((("\n" if held["some"] else "") + line).encode())
            held["some"] = True
        gaps = held["most"] - held["least"] + 1 - held["turns"] if held["least"] is not None else 0
        return (held["conv"], gaps, *held["counts"], held["cost"] + cost, "".join([*held["audit"], audit]), held["lines"].hexdigest())

    for batch in batches:
        rows = []
        for conv, _, _, state, audit, repaired, cost, *counts, first, last, least, most, turns in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held is None or held["conv"] != conv:
                if held is not None:
                    rows.append(close())
                held = {"conv": conv, "state": 0, "lines": hashlib.sha256(), "some": False, "counts": [0, 0, 0, 0], "cost": 0, "audit": [], "last": None, "least": None, "most": None, "turns": 0}
            held["state"] = state
            held["audit"].append(audit)
            held["cost"] += cost
            held["counts"] = [a + b for a, b in zip(held["counts"], counts, strict=True)]
            if repaired is not None:
                held["lines"].update((("\n" if held["some"] else "") + repaired).encode())
                held["some"] = True
            if first is not None:
                if held["last"] is not None and held["last"] + first not in ("su", "ua", "au"):
                    held["counts"][3] += 1
                held["last"] = last
            if least is not None:
                held["turns"] += turns - (held["most"] == least)
                held["least"], held["most"] = least if held["least"] is None else held["least"], most
        yield _batch(rows, RESULT)
    if held is not None:
        yield _batch([close()], RESULT)


def repaired(rows: DataFrame, size: int = ROWS, characters: int = BYTES, passes: int = PASSES) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    spark = rows.sparkSession
    folder = scratch(spark, "conversations")
    cut = chunks(rows, folder, size, characters)
    final = F.array(*map(F.lit, FINAL))
    columns = [*_ID, "tokens", "roles", "texts"]
    alone = cut.where("alone").select(*columns, final.alias("after"), F.lit(0).alias("state"), *_COUNTS).mapInArrow(_write, _PIECE).mapInArrow(_joined, RESULT)

    # Conversations that lie in several chunks or at the edge of a task: few, but for long ones.
    open_ = stored(cut.where("not alone").select(*_ID, "tokens", (F.size("texts") > 0).alias("real")), f"{folder}/open")
    vectors = settled(open_.where("real").select(*_ID, "tokens"), folder, passes)
    known = open_.select(*_ID, "tokens").join(vectors.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "after"),
                                              F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left")
    known = stored(known.select(*_ID, "tokens", F.coalesce("after", final).alias("after")), f"{folder}/known")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            out = []
            for conv, part, seq, tokens, after in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                passed = costs.vectors(tokens, tuple(after))
                out.append((conv, part, seq, [costs.end(tokens, passed, state) for state in range(4)]))
            yield _batch(out, "conv_id long, part long, seq long, ends array<int>")

    starts = _started(known.mapInArrow(lead, "conv_id long, part long, seq long, ends array<int>"))
    states = stored(known.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "after")
                    .join(starts.select(F.col("conv_id").alias("c1"), F.col("part").alias("p1"), F.col("seq").alias("s1"), "state"),
                          F.col("c").eqNullSafe(F.col("c1")) & (F.col("p") == F.col("p1")) & (F.col("s") == F.col("s1"))).select("c", "p", "s", "after", "state"), f"{folder}/states")
    long = cut.where("not alone").join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    pieces = stored(long.select(*columns, "after", "state", *_COUNTS).mapInArrow(_write, _PIECE), f"{folder}/pieces")
    whole = pieces.repartition("conv_id").sortWithinPartitions(*_ID).mapInArrow(_joined, RESULT)
    return alone.unionByName(whole)
