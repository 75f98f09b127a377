"""Cheapest repair of a conversation's turns by a fold of SQL expressions.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles.  Turns are
kept (0), given the role user or assistant (2), deleted (3; blank and repeated ones
must be), or an empty turn is inserted (2); a truncated turn that stays adds 1.  Four
states, nothing yet, after a system, a user, an assistant turn, each carry the cheapest
(cost, audit) so far; `aggregate` folds the turns in order and `least` compares the
structs, so among equal costs the ASCII-least audit wins.  That is exact: two audits of
equal cost over the same turns are never one the beginning of the other.

No task holds a conversation.  Turns are numbered in order over the whole table, in two
passes over ranges, and cut into runs of CHUNK numbers; a conversation's turns within a
run are folded once from each of the four states (from the first alone at its start).
Runs are joined like matrices, FAN at a time, round after round.  Equal rows of a
conversation are one turn with a count, whose copies are deleted at once.  Faults come
from a window over the turns of a run and from each text's first number in its
conversation, looked up by number, so no frequent text makes a hot key.

The repaired turns are read off the audit in a stream over the conversation's sorted
rows, one batch in memory.  A digest of a whole conversation has to see its turns in
order; that last stream is the only task that does.

Order of turns: by turn, nulls first, then role, the first characters of the text and
its digest.  Defined edge cases: a null role, text or part of the id is one space, which
is a blank text and a role that fits nowhere; a null conv_id is a conversation; rows
that repeat are duplicates; a conversation without rows has costs of zero and an empty
audit; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import common
from tandem.operators import ranking

#: Turns of a run and runs joined at once, as powers of two; characters of a text that order turns before its digest does.
CHUNK, FAN, HEAD = 7, 5, 32
#: `[^\x20\x09-\x0D]`: what makes a text not blank (fixed values).
SOLID = r"[^\x20\x09-\x0D]"
_STATES = "nsua"
_BEST = "struct<cost: bigint, audit: string>"
#: Dearer than any repair: a state that cannot be reached.
_NEVER = 1 << 50


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: rows spoilt by the checksum of `conv_id:turn`.

    Of twenty values 0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 gives
    it twice, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    marked = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind")).where(F.col("_kind") != 0)
    kind = F.col("_kind")
    return marked.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Turns with what orders them: the head of the text and a digest of role and text."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": digest})


_ORDER = ("conv_id", "turn", "role", "head", "digest")


def _turns(keyed: DataFrame) -> DataFrame:
    """One row for equal rows of a conversation, numbered in order: conv_id, turn, id, initial, digest, copies, blank, cut off."""
    rest = F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " "))
    flags = keyed.select(*_ORDER, "copies", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(SOLID)).alias("blank"), (~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("cut_off"))
    one = flags.groupBy(*_ORDER, "initial", "blank", "cut_off").agg(F.sum("copies").alias("copies"))
    order = [F.asc_nulls_first(c) for c in _ORDER]
    return ranking.numbered(one, order, "id", keep=common.cut).select("conv_id", "turn", "id", "initial", "digest", "copies", "blank", "cut_off")


def _faults(turns: DataFrame) -> DataFrame:
    """Turns with `again` (role and text stood earlier), `starts` (the conversation's first) and what stands before in the run."""
    first = turns.groupBy("conv_id", "digest").agg(F.min("id").alias("id"))
    begin = turns.groupBy("conv_id").agg(F.min("id").alias("id"))
    marks = first.select("id", F.lit(True).alias("fresh"), F.lit(False).alias("starts")).unionAll(begin.select("id", F.lit(False), F.lit(True))).groupBy("id").agg(F.bool_or("fresh").alias("fresh"), F.bool_or("starts").alias("starts"))
    out = turns.join(marks, "id", "left").withColumn("chunk", F.shiftright("id", CHUNK))
    before = F.lag("initial").over(Window.partitionBy("conv_id", "chunk").orderBy("id"))
    return out.withColumns({"again": ~F.coalesce("fresh", F.lit(False)), "starts": F.coalesce("starts", F.lit(False)), "before": before})


def _best(cost: Column | int, audit: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(cost).cast("bigint").alias("cost"), lit(audit).alias("audit"))


def _then(best: Column, cost: Column | int, edit: Column | str) -> Column:
    return _best(best["cost"] + cost, F.concat(best["audit"], edit if isinstance(edit, Column) else F.lit(edit)))


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inserted(state: Column) -> Column:
    """The states after an insertion, where that is cheaper: two in a row never are."""
    user = F.least(state["u"], *[_then(state[s], 2, "I") for s in "nsa"])
    return F.struct(state["n"].alias("n"), state["s"].alias("s"), user.alias("u"), F.least(state["a"], _then(state["u"], 2, "I")).alias("a"))


def _turned(at: Column, turn: Column) -> Column:
    """The states after a turn is kept, given a role or deleted, and its further copies are deleted."""
    stays = ~turn["drop"]
    rest = F.repeat(F.lit("D"), (turn["copies"] - 1).cast("int"))
    more = lambda best, cost, edit: _then(best, turn["copies"] * 3 - 3 + cost, F.concat(F.lit(edit), rest))
    gone = lambda s: [more(at[s], F.lit(3), "D"), _best(_NEVER, "")]
    keep = lambda initial, *sources: [F.when(stays & (turn["initial"] == initial), more(at[s], turn["extra"], "K")) for s in sources]
    change = lambda *sources: [F.when(stays, more(at[s], turn["extra"] + 2, "R")) for s in sources]
    return F.struct(  # least passes over the nulls of edits that are not allowed
        F.least(*gone("n")).alias("n"),
        F.least(*gone("s"), *keep("s", "n")).alias("s"),
        F.least(*gone("u"), *keep("u", "n", "s", "a"), *change("n", "s", "a")).alias("u"),
        F.least(*gone("a"), *keep("a", "u"), *change("u")).alias("a"),
    )


def _step(given: Column, turn: Column) -> Column:
    return _let(_inserted(given), lambda at: _turned(at, turn))


def _start(state: str) -> Column:
    return F.struct(*[_best(0 if s == state else _NEVER, "").alias(s) for s in _STATES])


def _folded(faults: DataFrame) -> DataFrame:
    """One row per conversation and run: counts of faults and, for each state before it, the four best after it."""
    drop = F.col("blank") | F.col("again")
    turn = F.struct("id", "initial", drop.alias("drop"), (~drop & F.col("cut_off")).cast("long").alias("extra"), "copies")
    n = F.col("copies")
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    one = faults.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.bool_or("starts").alias("starts"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(~F.col("blank"), F.when(F.col("again"), n).otherwise(n - 1)).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~drop & F.col("cut_off"), 1).otherwise(0)).alias("truncated"), F.sum(n - 1 + F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0)).alias("illegal"),
    )
    fold = lambda s: F.aggregate("turns", _start(s), _step)
    lanes = F.when(F.col("starts"), F.array(fold("n"))).otherwise(F.array(*[fold(s) for s in _STATES]))
    ends = F.get("turns", F.lit(0))["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last")
    return one.select("conv_id", "chunk", "blank", "duplicate", "truncated", "illegal", *ends, lanes.alias("lanes"))


def _joined(lanes: Column, more: Column) -> Column:
    """lanes followed by the next run's: of the ways through each state between, the cheapest."""
    through = lambda lane, end: F.least(_best(_NEVER, ""), *[_then(lane[s], F.get(more, F.lit(i))[end]["cost"], F.get(more, F.lit(i))[end]["audit"]) for i, s in enumerate(_STATES)])
    return F.transform(lanes, lambda lane: F.struct(*[through(lane, s).alias(s) for s in _STATES]))


def _merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with equal keys as one, in the order of `chunk`."""
    part = F.struct("chunk", "blank", "duplicate", "truncated", "illegal", "first", "last", "lanes")
    parts = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    count = lambda c: F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p[c]).alias(c)
    seam = F.aggregate(
        "parts", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("last")),
        lambda x, p: F.struct((x["n"] + p["illegal"] + F.when(x["last"].isNull() | F.concat(x["last"], p["first"]).isin("su", "ua", "au"), 0).otherwise(1)).cast("bigint").alias("n"), p["last"].alias("last")),
    )["n"].alias("illegal")
    head = F.get("parts", F.lit(0))
    lanes = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), head["lanes"], lambda x, p: _joined(x, p["lanes"]))
    return parts.select(*keys, count("blank"), count("duplicate"), count("truncated"), seam, head["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"), lanes.alias("lanes"))


def _audits(turns: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit."""
    runs = _folded(_faults(turns))
    longest = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds, reach = 0, 1 << (CHUNK + FAN)
    while reach < longest:
        rounds, reach = rounds + 1, reach << FAN
    for _ in range(rounds):
        runs = _merged(runs.withColumn("wide", F.shiftright("chunk", FAN)), ["conv_id", "wide"]).withColumnRenamed("wide", "chunk")
    done = _merged(runs, ["conv_id"])
    last = _inserted(F.get("lanes", F.lit(0)))
    best = F.least(last["n"], last["a"])
    return done.select("conv_id", "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def summary(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation (of `conversations`, if given)."""
    turns = _turns(_keyed(rows))
    spans = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("distinct"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce((wide("high") - wide("low") + 1 - wide("distinct")).cast("bigint"), F.lit(0)).alias("gaps")
    counts = "blank", "duplicate", "truncated", "illegal", "cost"
    found = _audits(turns).select("conv_id", F.lit(None).cast("bigint").alias("gaps"), *counts, "audit")
    zero = spans.select("conv_id", gaps, *[F.lit(None).cast("bigint").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"))
    every = found.unionByName(zero)
    if conversations is not None:
        every = every.unionByName(conversations.select("conv_id"), allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", *counts)], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))


_NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


class _Replay:
    """Reads repaired turns off an audit while a conversation's rows go by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, ""

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = _NEXT[self.state]
            self.state = role[0]
            yield "I", role, ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = _NEXT[self.state]
            self.state = role[0]
            yield edit, role, text


def _replay(turns_out: bool):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # summary row, replay, digest, place
        out: list[tuple] = []

        def add(turns):
            for edit, role, text in turns:
                if turns_out:
                    out.append((now[0]["conv_id"], now[3], edit, role, text))
                else:
                    now[2].update((b"\n" if now[3] else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                now[3] += 1

        def close():
            if now is not None:
                add(now[1].inserted())
                if not turns_out:
                    out.append((now[0]["conv_id"], *[now[0][c] for c in columns], now[2].hexdigest()))

        def flush(schema):
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            if turns_out:
                schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            else:
                schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in columns[:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for a, n in common.slices(batch.column("text")):
                for r in batch.slice(a, n).to_pylist():
                    if r["role"] is None:
                        close()
                        now = [r, _Replay(r["audit"]), hashlib.sha256(), 0]
                    else:
                        add(now[1].row(r["role"], r["text"], r["copies"]))
                yield flush(schema)
        if now is not None:
            close()
            yield flush(schema)

    return run


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's summary, then its rows in order, side by side in one partition."""
    turns = _keyed(rows).select(*_ORDER, "text", "copies")
    both = turns.withColumn("later", F.lit(True)).unionByName(found.withColumn("later", F.lit(False)), allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "later", *_ORDER[1:])]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "copies", *[c for c in found.columns if c != "conv_id"])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _stream(rows, common.cut(summary(rows))).mapInArrow(_replay(True), f"conv_id {kind}, place long, edit string, role string, text string")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """`summary` and repaired_sha256, the digest of the repaired `role:text` joined by newlines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _stream(rows, summary(rows, conversations)).mapInArrow(_replay(False), f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
