"""Conversation structure repair: cheapest edits of roles and faults, found on signatures that share their ends.

A conversation's signature has one sign a row: what must go, or the role's initial and whether the text is cut off. The cost of
what is left to do from some row on depends on the rest of the signature and the grammar's state alone. So the signatures of
all conversations are taken once each and sorted by their ends; in that order each signature shares the nodes of its end with
the one before (a suffix-shared acyclic automaton whose nodes are built from the end), and cost-to-go and best edit are found
once per node and grammar state. Nodes whose costs differ by a constant only are one state of a minimised automaton: there are
few dozen of those, whatever the corpus, so the edits of a node are looked up, and an audit is read by walking its nodes.

A conversation of any length is cut into pieces of at most PIECE rows, so no task holds more than that of one. A piece's edits
depend on the state of the minimised automaton at its end, which is carried over pieces from the last to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WORD, map_arrow, materialize, partitions, release

PIECE = 512
#: Grammar states: nothing yet, after system, after user, after assistant. The roles of a result are (s?(ua)+)?.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NEVER = 1 << 40

Costs = tuple[int, int, int, int]


def after_keeping(state: int, role: str) -> int | None:
    """The state after a row with that initial, None where it isn't allowed."""
    if role == "s":
        return SYSTEM if state == START else None
    goes = {"u": USER, "a": ASSISTANT}.get(role)
    return goes if goes == FOLLOWS[state] else None


def with_insertions(costs: list[int]) -> Costs:
    """Least costs from each state before a row (or the end) where rows may be put in first."""
    out = list(costs)
    for _ in range(3):  # a row put in leads at most from START over USER to ASSISTANT
        out = [min(out[q], INSERT + out[FOLLOWS[q]]) for q in range(4)]
    return tuple(out)


#: Cost-to-go behind the last row: nothing is left to do at the start and after an assistant.
END: Costs = with_insertions([0, NEVER, NEVER, 0])


def options(sign: str, rest: Costs, own: Costs | None, state: int) -> list[tuple[int, str, int, bool]]:
    """(cost-to-go, edit, next state, row used up) of each edit in a state, before a row of that sign."""
    out = [(DELETE + rest[state], "D", state, True)]
    if own is not None:
        out.append((INSERT + own[FOLLOWS[state]], "I", FOLLOWS[state], False))
    if sign != "d":
        more = CUT_OFF if sign.isupper() else 0
        goes = after_keeping(state, sign.lower())
        if goes is not None:
            out.append((KEEP + more + rest[goes], "K", goes, True))
        out.append((REROLE + more + rest[FOLLOWS[state]], "R", FOLLOWS[state], True))
    return out


@cache
def before(sign: str, rest: Costs) -> tuple[Costs, int]:
    """Costs before a row of that sign, less their minimum, and the minimum: a transition of the minimised automaton."""
    costs = with_insertions([min(options(sign, rest, None, q))[0] for q in range(4)])
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def edits(sign: str, rest: Costs, state: int) -> tuple[str, int, int]:
    """The edits up to and with the row's own, in letters that are small for an assistant, the state after it, and their cost.

    Edits of one state begin with different letters, so of equally cheap ones the ASCII-least letter begins the least audit.
    """
    own, least = before(sign, rest)
    said, paid = "", 0
    while True:
        cost, edit, goes, used = min(options(sign, rest, tuple(c + least for c in own), state))
        step = cost - (rest[goes] if used else own[goes] + least)
        said, paid = said + (edit.lower() if edit in "IR" and goes == ASSISTANT else edit), paid + step
        if used:
            return said, goes, paid
        state = goes


@cache
def tail(state: int) -> tuple[str, int]:
    """What is put in behind the last row, and its cost."""
    said = {START: "", ASSISTANT: "", USER: "i", SYSTEM: "Ii"}[state]
    return said, INSERT * len(said)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), damaged by crc32(`conv_id:turn`) % 20.

    0 drops a row, 1 empties its text, 2 takes . ! and ? out of it, 3 repeats it, 4 makes its role user; nulls stand for one space.
    """
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(said.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


#: Order of a conversation's rows; rows that are equal in all of it are equal.
ORDER = ["conv", "turn", "role", "mark"]


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    mark = F.unhex(F.sha2("text", 256))
    return rows.select(F.col("conv_id").alias("conv"), "turn", "role", mark.alias("mark"), *more)


def _ends_well(text: Column) -> Column:
    """Whether the last character other than white space is . ! or ?."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1).isin(".", "!", "?")


def _pieces(rows: DataFrame) -> DataFrame:
    """conv, part, nth, turn, role, mark, signs: runs of a conversation's rows in order, with the key of the first.

    part and nth order the pieces of a conversation. Signs: b blank, r repeated, else the initial (s, u, a, o for others),
    in capitals where the text is cut off.
    """
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(F.col("blank"), "b").when(F.col("well"), letter).otherwise(F.upper(letter))
    each = _keyed(rows.withColumns({"blank": ~F.col("text").rlike(WORD), "well": _ends_well(F.col("text"))}).withColumn("sign", sign), "sign")
    # equal rows are one with a count, and each role and text has one first turn, so no key needs to meet in one task
    each = materialize(each.groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("sign").alias("sign")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("had"), F.col("turn").alias("at"))
    first = each.where("sign <> 'b'").groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("mark").alias("_m")).agg(F.min(place).alias("first"))
    on = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("mark") == F.col("_m"))
    again = F.coalesce(place > F.col("first"), F.lit(False))
    each = each.join(first, on, "left").select(*ORDER, "n", F.when(again, "r").otherwise(F.col("sign")).alias("sign"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    ranged = each.repartitionByRange(max(8, partitions(each.sparkSession)), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    kinds = dict(each.dtypes)
    names = [*ORDER, "part", "nth", "signs"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, signs, nth, out = None, "", 0, []
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(c) for c in names[:5]], ("nth", pa.int64()), ("signs", pa.string())])
            for *key, n, sign in zip(*[batch.column(c).to_pylist() for c in [*names[:5], "n", "sign"]], strict=True):
                if first is not None and first[0] != key[0]:
                    out.append([*first, nth, signs])
                    first, signs, nth = None, "", 0
                left = n  # the first of equal rows has the sign, the others repeat it
                while left:
                    if len(signs) == PIECE:
                        out.append([*first, nth, signs])
                        first, signs, nth = None, "", nth + 1
                    first, take = first or key, min(PIECE - len(signs), left)
                    again = "b" if sign == "b" else "r"
                    signs += (sign if left == n else again) + again * (take - 1)
                    left -= take
                    if len(out) >= BATCH_ROWS:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)
                out = []
        if first is not None:
            yield _batch([[*first, nth, signs]], schema)

    return map_arrow(ranged, cut, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, mark binary, part int, nth long, signs string")


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)


def _by_ends(signs: DataFrame, *first: str) -> DataFrame:
    """Each different row once, in ranges sorted by the end of `signs` (what stands in `first` before it)."""
    order = [*first, F.reverse("signs")]
    return signs.distinct().repartitionByRange(max(8, partitions(signs.sparkSession)), *order).sortWithinPartitions(*order)


class Nodes:
    """The nodes of one signature, from its end, in a stack; those of the end that the next one shares stay."""

    def __init__(self):
        self.signs, self.costs = "", []

    def upto(self, signs: str, rest: list[Costs]) -> None:
        """Makes the stack that of signs, read from its last sign; costs[k][i] are those before the sign k from the end, if rest[i] follows."""
        turned = signs[::-1]
        same = 0
        if self.costs and self.costs[0] == rest:
            for same, (a, b) in enumerate(zip(turned, self.signs, strict=False)):  # noqa: B007
                if a != b:
                    break
            else:
                same = min(len(turned), len(self.signs))
        self.costs = self.costs[: same + 1] if same or self.costs[:1] == [rest] else [rest]
        for sign in turned[same:]:
            self.costs.append([before(sign, c)[0] for c in self.costs[-1]])
        self.signs = turned


def states() -> list[Costs]:
    """All states of the minimised automaton, END's first."""
    found = [END]
    for costs in found:
        for sign in "dsuaoSUAO":
            if (after := before(sign, costs)[0]) not in found:
                found.append(after)
    return found


def _entries(pieces: DataFrame) -> DataFrame:
    """signs and, for each state at a piece's end, the state at its beginning: a list of numbers of states()."""
    def each(batches):
        known = states()
        number, nodes = {c: i for i, c in enumerate(known)}, Nodes()
        for batch in batches:
            out = []
            for signs in batch.column("signs").to_pylist():
                nodes.upto(signs, known)
                out.append([signs, [number[c] for c in nodes.costs[-1]]])
            if out:
                yield _batch(out, pa.schema([("signs", pa.string()), ("entry", pa.list_(pa.int32()))]))

    return map_arrow(_by_ends(pieces.select("signs")), each, "signs string, entry array<int>")


def _audits(pieces: DataFrame) -> DataFrame:
    """signs, leaves (the state at the end) and, for each grammar state at the beginning, edits and goes (the grammar state after)."""
    def each(batches):
        known, nodes = states(), Nodes()
        for batch in batches:
            out = []
            for signs, leaves in zip(batch.column("signs").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
                nodes.upto(signs, [known[leaves]])
                made, goes = [], []
                for state in range(4):
                    said = []
                    for k, sign in enumerate(signs):
                        word, state, _ = edits(sign, nodes.costs[len(signs) - k - 1][0], state)
                        said.append(word)
                    made.append("".join(said))
                    goes.append(state)
                out.append([signs, leaves, made, goes])
            if out:
                yield _batch(out, pa.schema([("signs", pa.string()), ("leaves", pa.int32()), ("edits", pa.list_(pa.string())), ("goes", pa.list_(pa.int32()))]))

    return map_arrow(_by_ends(pieces.select("leaves", "signs"), "leaves"), each, "signs string, leaves int, edits array<string>, goes array<int>")


def _chained(df: DataFrame, order: list[Column], column: str, table: str, start: int, name: str) -> DataFrame:
    """Adds name: `start` for the first piece of each conversation in that order, else the last one's table[its own name].

    Only conversations of several pieces come here; a task holds one row at a time.
    """
    fields = df.schema.fields

    def each(batches):
        conv, state, begun = None, start, False
        for batch in batches:
            out = []
            for c, steps in zip(batch.column("conv").to_pylist(), batch.column(table).to_pylist(), strict=True):
                if not begun or c != conv:
                    conv, state, begun = c, start, True
                out.append(state)
                state = steps[state]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, name])

    ranged = df.repartition(partitions(df.sparkSession), column).sortWithinPartitions(column, *order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(ranged, each, f"{types}, {name} int")


def _edited(pieces: DataFrame) -> DataFrame:
    """pieces with the edits of each."""
    bare = F.translate("signs", "br", "dd")
    last = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("part"), F.desc("nth"))) == 1
    # a conversation of one piece is known by its place; a window over pieces has a row for PIECE rows
    pieces = materialize(pieces.withColumn("last", last).withColumn("first", F.row_number().over(Window.partitionBy("conv").orderBy("part", "nth")) == 1), "pieces")
    named = pieces.withColumns({"shown": F.col("signs"), "signs": bare})
    single, several = named.where("last and first"), named.where("not (last and first)")
    entries = materialize(_entries(several), "entries")
    held = several.join(entries, "signs")
    backward = _chained(held, [F.desc("part"), F.desc("nth")], "conv", "entry", 0, "leaves").drop("entry")
    backward = materialize(backward.unionByName(single.withColumn("leaves", F.lit(0))), "leaves")
    audits = materialize(_audits(backward), "audits")
    held = backward.join(audits, ["signs", "leaves"])
    alone, many = held.where("last and first").withColumn("enters", F.lit(START)), held.where("not (last and first)")
    forward = _chained(many, [F.col("part"), F.col("nth")], "conv", "goes", START, "enters")
    out = alone.unionByName(forward).withColumn("said", F.get("edits", F.col("enters"))).drop("edits", "goes", "signs", "leaves", "enters", "first", "last")
    out = materialize(out.withColumnRenamed("shown", "signs"), "edits")
    release(pieces, entries, backward, audits)
    return out


class _Report:
    """Counts, audit and hash of one conversation, fed row by row."""

    def __init__(self, conv):
        self.conv, self.audit, self.hash, self.lines = conv, [], hashlib.sha256(), 0
        self.count = dict.fromkeys("br", 0) | {"cut": 0}
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.illegal, self.role, self.cost, self.state = 0, None, 0, START
        self.queue: list[tuple[str, str]] = []
        self.at = self.edit = 0

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _put_in(self, letter: str) -> None:
        self.line("assistant" if letter == "i" else "user", "")
        self.cost += INSERT
        self.audit.append("I")
        self.state = ASSISTANT if letter == "i" else USER

    def row(self, turn, role: str, text: str) -> None:
        signs, said = self.queue[0]
        sign = signs[self.at]
        while said[self.edit] in "Ii":
            self._put_in(said[self.edit])
            self.edit += 1
        edit = said[self.edit]
        self.audit.append(edit.upper())
        cut = sign.isupper()
        self.count[sign if sign in "br" else "cut"] += sign in "br" or cut
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += CUT_OFF * cut + (REROLE if edit in "Rr" else KEEP)
            kept = {"R": "user", "r": "assistant"}.get(edit, role)
            self.line(kept, text)
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[kept[:1]]
        self.at, self.edit = self.at + 1, self.edit + 1
        if self.at == len(signs):
            self.queue.pop(0)
            self.at = self.edit = 0
        if self.role is not None:
            self.illegal += self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last
            self.last = turn

    def done(self) -> list:
        for letter in tail(self.state)[0]:
            self._put_in(letter)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv, gaps, self.count["b"], self.count["r"], self.count["cut"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conv_id of rows, before damage.

    rows: conv_id, turn, role, text, the last two strings; other columns are ignored. They are damaged first. A conversation's
    rows go by turn, nulls first, then by role and by the text's SHA-256; equal rows are interchangeable. Null ids are one
    conversation, null roles and texts one space. A conversation of which damage leaves nothing has zeros, an empty audit and
    the hash of nothing. An empty table gives an empty one. The hash of a conversation is a chain over its texts, so they pass
    through one task, row by row; nothing of them is kept.
    """
    own = rows.select("conv_id", "turn", "role", "text")
    left = damaged(own)
    pieces = _edited(_pieces(left))
    nothing = lambda df, **more: df.withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    # kind orders what has one key: the conversation itself, its pieces, its rows
    convs = nothing(own.select(F.col("conv_id").alias("conv")).distinct(), turn=dict(own.dtypes)["turn"], role="string", mark="binary", part="int", nth="long", signs="string", said="string", text="string")
    edits_ = nothing(pieces.select(*ORDER, "part", "nth", "signs", "said"), text="string")
    texts = nothing(_keyed(left, "text"), part="int", nth="long", signs="string", said="string")
    every = convs.withColumn("kind", F.lit(0)).unionByName(edits_.withColumn("kind", F.lit(1))).unionByName(texts.withColumn("kind", F.lit(2)))
    order = [F.col("conv").asc_nulls_first(), F.col("kind") > 0, F.col("turn").asc_nulls_first(), "role", "mark", "kind", "part", "nth"]
    every = every.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions(*order)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def each(batches):
        now, out = None, []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv").type), *[(n, pa.int64()) for n in names[1:7]], *[(n, pa.string()) for n in names[7:]]])
            columns = [batch.column(c).to_pylist() for c in ("kind", "conv", "turn", "role", "text", "signs", "said")]
            for kind, conv, turn, role, text, signs, said in zip(*columns, strict=True):
                if kind == 0:
                    if now:
                        out.append(now.done())
                    now = _Report(conv)
                elif kind == 1:
                    now.queue.append((signs, said))
                else:
                    now.row(turn, role, text)
            if out:
                yield _batch(out, schema)
                out = []
        if now:
            yield _batch([now.done()], schema)

    types = f"conv_id {dict(own.dtypes)['conv_id']}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string"
    return map_arrow(every, each, types)
