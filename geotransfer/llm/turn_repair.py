"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``.

Every row is kept, given another role or deleted, and empty user or assistant rows may be
inserted. ``search`` finds the cheapest edits, among these the least audit string, by depth-first
branch and bound: an explicit stack, a lower bound of the cost of every suffix, an incumbent
(cost, audit), and a table per node (row, state) that drops a prefix worse than one seen there.
When the stack is empty the incumbent is proved optimal.

States: 0 nothing written yet, 1 a system row, 2 a user row (an assistant row must follow),
3 an assistant row. A conversation ends in 0 or 3.

A search sees at most ``SEGMENT`` rows, as one letter each. Longer conversations are searched in
segments, each for every state at its begin and end, and the segments' tables are joined in order
of (cost, audit); so no task gathers the texts of a conversation. Rows equal in turn, role and
text travel as one row with a count: all but the first are duplicates that go.

Edits that are equal in cost differ in their audit only, so insertions are looked for where the
least audit has them: right before a row that stays, or at the end (``DI`` is less than ``ID``);
two in a row are never cheapest there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geotransfer.llm.common import mapped
from geotransfer.operators import ordering
from geotransfer.operators.joins import null_safe_join
from geotransfer.session import materialize

SEGMENT = 128
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3  # costs; CUT is added to a truncated row that is not deleted
NAMES = {"u": "user", "a": "assistant"}
TAIL = {0: 0, 1: 2, 2: 1, 3: 0}  # insertions that end a conversation from a state
END = 4


# ---------------------------------------------------------------- search

def moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letters, cost, next state) of a row: ``d`` must go, ``s u a x`` by role, upper case if truncated."""
    out = [("D", DELETE, state)]
    if code == "d":
        return out
    cut = CUT if code.isupper() else 0
    base = code.lower()
    due = "a" if state == 2 else "u"
    for role in "ua":
        extra, letter = (0, "") if role == due else (INSERT, "I")
        after = 2 if role == "u" else 3
        if base == role:
            out.append((letter + "K", extra + cut, after))
        out.append((letter + "R", extra + REROLE + cut, after))
    if base == "s" and state == 0:
        out.append(("K", cut, 1))
    return out


_MOVES = {(c, s): moves(c, s) for c in "dsuaxSUAX" for s in range(4)}


def suffix_bounds(codes: str, copies: list[int], exit_: int = END) -> list[list[float]]:
    """Lower bound of the cost of every suffix from every state: four numbers a row, audits left aside.

    Without the audits this bound is tight, so the search leaves the cheapest paths only to prove
    that no audit of equal cost is less, and its work grows with the rows on any input. Simpler
    bounds (cheapest edit of every row and pairs of like neighbours) let runs of truncated rows,
    where most edits tie, grow exponentially.
    """
    bounds = [[INSERT * TAIL[s] if exit_ == END else 0 if s == exit_ else float("inf") for s in range(4)]]
    for code, n in zip(reversed(codes), reversed(copies)):
        after = bounds[-1]
        bounds.append([min(price + after[to] for _, price, to in _MOVES[code, s]) + DELETE * (n - 1) for s in range(4)])
    return bounds[::-1]


def search(codes: str, copies: list[int], entry: int, exit_: int = END) -> tuple[int, str] | None:
    """Cheapest (cost, audit) that leads from a state to another one or, for ``END``, to the end of the conversation."""
    n = len(codes)
    bounds = suffix_bounds(codes, copies, exit_)
    twins = ["D" * (c - 1) for c in copies]
    incumbent = None  # stays so when no edits lead there
    seen = {(0, entry): (0, "")}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, state = stack.pop()
        if seen[i, state] != (cost, audit):
            continue
        if i == n:
            ending = TAIL[state] if exit_ == END else 0
            out = (cost + INSERT * ending, audit + "I" * ending)
            incumbent = min(incumbent, out) if incumbent else out
            continue
        children = []
        for letters, price, after in _MOVES[codes[i], state]:
            cost_, audit_ = cost + price + DELETE * (copies[i] - 1), audit + letters + twins[i]
            bound = cost_ + bounds[i + 1][after]
            if bound == float("inf") or incumbent and (bound, audit_) > (incumbent[0], incumbent[1][:len(audit_)]):
                continue
            node = (i + 1, after)
            if node in seen and seen[node] <= (cost_, audit_):
                continue
            seen[node] = (cost_, audit_)
            children.append((bound, audit_, cost_, after))
        for _, audit_, cost_, after in sorted(children, reverse=True):
            stack.append((cost_, audit_, i + 1, after))
    return incumbent


def steps(codes: str, copies: list[int], entry: int, audit: str) -> tuple[list[str], str]:
    """What every row becomes, in letters: a leading ``u`` or ``a`` for an inserted row, then ``D``, ``K`` or
    ``U``/``A`` for the new role. Last the letters of the rows inserted at the end."""
    out, state, at = [], entry, 0
    for code, n in zip(codes, copies):
        text = ""
        if audit[at] == "I":
            text, state, at = ("a", 3, at + 1) if state == 2 else ("u", 2, at + 1)
        letter = audit[at]
        if letter == "R":
            text, state = (text + "A", 3) if state == 2 else (text + "U", 2)
        else:
            text += letter
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[code.lower()]
        at += n  # the letter and those of the twins
        out.append(text)
    return out, {0: "", 1: "ua", 2: "a", 3: ""}[state] if at < len(audit) else ""


def joined_segments(tables: list[dict[tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int]]:
    """Entry and exit state of every segment of the cheapest path, ties to the least audit.

    ``tables`` hold (cost, place of the audit among the segment's audits). No audit of the same
    rows is the beginning of another, so prefixes are compared by place and then by the segment's.
    """
    front, back = {0: (0, 0)}, []
    for table in tables:
        reached: dict[int, tuple[int, int, int, int]] = {}
        for (entry, exit_), (cost, place) in table.items():
            if entry in front:
                option = (front[entry][0] + cost, front[entry][1], place, entry)
                if exit_ not in reached or option < reached[exit_]:
                    reached[exit_] = option
        order = sorted({r[1:3] for r in reached.values()})
        back.append({e: r[3] for e, r in reached.items()})
        front = {e: (r[0], order.index(r[1:3])) for e, r in reached.items()}
    state, path = END, []
    for came in reversed(back):
        path.append((came[state], state))
        state = came[state]
    return path[::-1]


# ---------------------------------------------------------------- faults

def faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct rows with ``pos`` (from 1 by turn, role, text), ``n`` copies, ``total`` rows and the fault flags.

    ``blank``, ``duplicate`` (of an earlier row; the copies of a row beyond the first are duplicates
    unless blank) and ``truncated`` exclude each other. The table is stored.
    """
    own = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    rows = materialize(df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), own(role).alias("role"),
                                 own(text).alias("text")).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")))
    placed = materialize(ordering.number_rows(rows, ["turn", "role", "text"], ["conv"], "pos", "total").withColumn(
        "key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    again = placed.groupBy("conv", "key").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1")
    rows = null_safe_join(placed, again.drop("c"), ["conv", "key"], "left")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    blank, twice = last == "", F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return rows.select("conv", "turn", "role", "text", "pos", "n", "total", letter.alias("letter"), blank.alias("blank"),
                       (~blank & twice).alias("duplicate"), (~blank & ~twice & ~last.isin(".", "!", "?")).alias("truncated"))


def _segments(rows: DataFrame) -> DataFrame:
    """One row per segment: its rows as letters, initials and counts (at most ``SEGMENT`` values)."""
    code = F.when(F.col("blank") | F.col("duplicate"), "d").otherwise(
        F.when(F.col("truncated"), F.upper("letter")).otherwise(F.col("letter")))
    packed = rows.withColumn("seg", F.floor((F.col("pos") - 1) / SEGMENT)).groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", code.alias("code"), "letter", "n"))).alias("r"), F.max("total").alias("total"))
    part = lambda name: F.transform("r", lambda x: x[name])
    return packed.select("conv", "seg", (F.col("seg") + 1 >= F.col("total") / SEGMENT).alias("final"),
                         F.array_join(part("code"), "").alias("codes"), F.array_join(part("letter"), "").alias("letters"),
                         part("n").alias("copies"))


def _search_task(batches):
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("seg", "final", "codes", "letters", "copies")])
        found, illegal = [], []
        for seg, final, codes, letters, copies in rows:
            found_here = [(entry, exit_, search(codes, copies, entry, exit_)) for entry in ((0,) if seg == 0 else range(4))
                          for exit_ in ((END,) if final else range(4))]
            table = [(entry, exit_, *best) for entry, exit_, best in found_here if best]
            places = {a: k for k, a in enumerate(sorted({t[3] for t in table}))}
            found.append([dict(entry=e, exit=x, cost=c, place=places[a], audit=a) for e, x, c, a in table])
            pairs = zip(letters, letters[1:])
            illegal.append(sum(p + q not in ("su", "ua", "au") for p, q in pairs) + sum(copies) - len(copies))
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("seg"), b.column("codes"), b.column("copies"), pa.array(illegal, pa.int64()),
             pa.array([x[:1] for x in b.column("letters").to_pylist()]), pa.array([x[-1:] for x in b.column("letters").to_pylist()]),
             pa.array(found, _TABLE)], ["conv", "seg", "codes", "copies", "illegal", "begins", "ends", "table"])


_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()),
                             ("audit", pa.string())]))
_TABLE_SQL = "array<struct<entry:int,exit:int,cost:bigint,place:int,audit:string>>"


def _path_task(batches):
    for b in batches:
        paths = []
        for parts in b.column("parts").to_pylist():
            tables = [{(t["entry"], t["exit"]): (t["cost"], t["place"]) for t in p["slim"]} for p in parts]
            paths.append([dict(seg=p["seg"], entry=e, exit=x) for p, (e, x) in zip(parts, joined_segments(tables))])
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(paths, pa.list_(pa.struct(
            [("seg", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])))], ["conv", "path"])


def _steps_task(batches):
    for b in batches:
        made = [steps(*row) for row in zip(*[b.column(c).to_pylist() for c in ("codes", "copies", "entry", "audit")])]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("conv", "seg", "cost", "illegal", "begins", "ends", "audit")],
             pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made])],
            ["conv", "seg", "cost", "illegal", "begins", "ends", "audit", "steps", "tail"])


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``faults``, a row per segment: ``cost``, ``audit``, ``steps``, ``tail``."""
    kind = rows.schema["conv"].dataType.simpleString()
    found = materialize(mapped(_segments(rows), _search_task,
                               f"conv {kind}, seg bigint, codes string, copies array<bigint>, illegal bigint, begins string, "
                               f"ends string, table {_TABLE_SQL}"))
    longer = found.where("seg > 0").select("conv").distinct()
    slim = F.transform("table", lambda t: F.struct(t["entry"].alias("entry"), t["exit"].alias("exit"), t["cost"].alias("cost"),
                                                   t["place"].alias("place")))
    parts = found.join(longer.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left_semi").groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("seg", slim.alias("slim")))).alias("parts"))
    paths = mapped(parts, _path_task, f"conv {kind}, path array<struct<seg:bigint,entry:int,exit:int>>").select(
        "conv", F.inline("path"))
    one = null_safe_join(found, paths, ["conv", "seg"], "left").withColumn("pick", F.element_at(F.filter(
        "table", lambda t: F.when(F.col("entry").isNull(), t["exit"] == END).otherwise(
            (t["entry"] == F.col("entry")) & (t["exit"] == F.col("exit")))), 1))
    chosen = one.select("conv", "seg", "codes", "copies", "illegal", "begins", "ends", F.col("pick.entry").alias("entry"),
                        F.col("pick.cost").alias("cost"), F.col("pick.audit").alias("audit"))
    return materialize(mapped(chosen, _steps_task, f"conv {kind}, seg bigint, cost bigint, illegal bigint, begins string, "
                                                   "ends string, audit string, steps array<string>, tail string"))


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations of ``faults`` and ``edits``: ``conv``, ``pos``, ``sub``, ``role``, ``text``, ``edit``.

    Ordered by (pos, sub). Inserted rows have an empty text and stand before row ``pos``.
    """
    each = plan.select("conv", F.col("seg"), F.posexplode("steps").alias("k", "step")).select(
        "conv", (F.col("seg") * SEGMENT + F.col("k") + 1).alias("pos"), "step").where("step <> 'D'")
    kept = null_safe_join(rows.select("conv", "pos", "role", "text"), each, ["conv", "pos"])
    name = lambda c: F.when(F.lower(c) == "u", NAMES["u"]).otherwise(NAMES["a"])
    act = F.right("step", F.lit(1))
    own = kept.select("conv", "pos", F.lit(1).alias("sub"), F.when(act == "K", F.col("role")).otherwise(name(act)).alias("role"),
                      "text", F.when(act == "K", "K").otherwise("R").alias("edit"))
    before = each.where("length(step) = 2").select("conv", "pos", F.lit(0).alias("sub"), name(F.left("step", F.lit(1))).alias("role"),
                                                   F.lit("").alias("text"), F.lit("I").alias("edit"))
    after = plan.where("tail <> ''").select("conv", (F.col("seg") * SEGMENT + F.size("steps") + 1).alias("pos"),
                                            F.posexplode(F.split("tail", "")).alias("sub", "r")).select(
        "conv", "pos", "sub", name(F.col("r")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    return own.unionByName(before).unionByName(after)


def summary(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation: ``gaps``, counts of faults, ``illegal`` neighbours, ``cost`` and ``audit``."""
    faulty = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - 1 + F.col("duplicate").cast("int"))).alias("duplicate"),
        F.sum(F.col("truncated").cast("bigint")).alias("truncated"))
    part = F.sort_array(F.collect_list(F.struct("seg", "begins", "ends", "audit", "tail")))
    pairs = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))),
                       lambda a, b: (~F.concat(a["ends"], b["begins"]).isin("su", "ua", "au")).cast("bigint"))
    edited = plan.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("inner"), part.alias("p")).select(
        "conv", "cost", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"),
        (F.col("inner") + F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("illegal"))
    return null_safe_join(faulty, edited, ["conv"])


def _digest_task(batches):
    held, digest, none = None, None, True
    for b in batches:
        convs, digests = [], []
        for conv, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist()):
            if none or conv != held:
                if not none:
                    convs.append(held)
                    digests.append(digest.hexdigest())
                held, none, digest = conv, False, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield _digest_batch(convs, digests, b.schema.field("conv").type)
        kind = b.schema.field("conv").type
    if not none:
        yield _digest_batch([held], [digest.hexdigest()], kind)


def _digest_batch(convs, digests, kind):
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], ["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of every repaired conversation (``role:text`` joined by newlines), read as a sorted stream, never gathered."""
    lines = turns.select("conv", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    streams = lines.repartition("conv").sortWithinPartitions("conv", "pos", "sub").select("conv", "line")
    return mapped(streams, _digest_task, f"conv {turns.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def report(df: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
           ) -> DataFrame:
    """``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    One row per conversation of ``ids`` (column ``conv``). Rows stand by turn, null first; rows of
    one turn by role and text. Null roles and texts are one space, so such a text is blank. Null
    conversation ids form one conversation. Repeated rows are duplicates and go. A conversation
    without rows, and an empty table's, has zeros, an empty audit and the digest of nothing. Long
    conversations are searched in segments, long texts are hashed as a stream. Extra columns are
    not read.
    """
    rows = materialize(faults(df, conv, turn, role, text))
    plan = edits(rows)
    out = null_safe_join(ids.select("conv").distinct(), summary(rows, plan), ["conv"], "left")
    out = null_safe_join(out, digests(repaired(rows, plan)), ["conv"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, chosen by the checksum of ``conv:turn``: for tests and the registered query.

    Of twenty rows one is dropped, one loses its text, one its ends of sentences, one is repeated,
    and one becomes a user's. Null cells are one space.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    pick = F.pmod(F.crc32(F.concat(space(conv), F.lit(":"), space(turn))), F.lit(20))
    kept = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"),
                     space(text).alias("text"), pick.alias("pick")).where("pick <> 0")
    return kept.select("conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("pick") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
