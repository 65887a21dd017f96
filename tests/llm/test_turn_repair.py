"""Conversation repair against exhaustive search, and the registered query against a plain version."""

import hashlib
import random
import re
import zlib

from geotransfer.llm import turn_repair
from geotransfer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos int, n string"
GOAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, most_inserts=3):
    """Every sequence of edits with a few insertions a gap, kept only while it is the least of its state."""
    front = {"": (0, "", ())}  # roles written so far, as far as they matter -> (cost, audit, repaired)

    def trim(roles):
        return roles if len(roles) <= 1 else ("s" if roles[0] == "s" else "") + ("ua" if roles[-1] == "a" else "u")

    def add(into, roles, item):
        if re.fullmatch(r"s?(ua)*u?", roles):
            key = trim(roles)
            if key not in into or item[:2] < into[key][:2]:
                into[key] = item

    def inserted(front):
        out = dict(front)
        for _ in range(most_inserts):
            for roles, (c, a, rep) in list(out.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    add(out, roles + r, (c + 3, a + "I", rep + (name + ":",)))
        return out

    for (role, text), fault in zip(rows, fault_of(rows)):
        after = {}
        for roles, (c, a, rep) in inserted(front).items():
            add(after, roles, (c + 4, a + "D", rep))
            if fault in ("blank", "duplicate"):
                continue
            cut = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a"):
                add(after, roles + role[:1], (c + cut, a + "K", rep + (f"{role}:{text}",)))
            for r, name in (("u", "user"), ("a", "assistant")):
                add(after, roles + r, (c + 3 + cut, a + "R", rep + (f"{name}:{text}",)))
        front = after
    return min((v[:2] + (v[2],) for k, v in inserted(front).items() if GOAL.fullmatch(k)), key=lambda v: v[:2])


def exhaustive(codes):
    """All edits of a few rows, without any table: (cost, audit)."""
    best = None

    def go(i, roles, cost, audit, gap):
        nonlocal best
        if not re.fullmatch(r"s?(ua)*u?", roles) or (best and cost > best[0]):
            return
        if i == len(codes) and GOAL.fullmatch(roles):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if gap < 3:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", gap + 1)
        if i < len(codes):
            c = codes[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if c != "d":
                cut = 3 if c.isupper() else 0
                if c.lower() != "x":
                    go(i + 1, roles + c.lower(), cost + cut, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_search_is_optimal_and_least():
    rng = random.Random(1)
    for k in range(300):
        codes = "".join(rng.choice("dsuaxSUAXuaua") for _ in range(rng.randint(1, 6)))
        assert turn_repair.search(codes, [1] * len(codes), 0) == exhaustive(codes), codes


def test_bounds_never_pass_the_cost():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randint(1, 7)))
        for entry in range(4):
            for exit_ in range(5):
                best = turn_repair.search(codes, [1] * len(codes), entry, exit_)
                bound = turn_repair.suffix_bounds(codes, [1] * len(codes), exit_)[0][entry]
                assert bound == float("inf") if best is None else bound <= best[0]


def test_segments_join_to_the_whole():
    rng = random.Random(3)
    for _ in range(100):
        codes = "".join(rng.choice("dsuaxSUAXuauaua") for _ in range(rng.randint(4, 40)))
        copies = [rng.choice([1, 1, 1, 3]) for _ in codes]
        whole = turn_repair.search(codes, copies, 0)
        size, found, tables = rng.randint(1, 9), [], []
        for k in range(0, len(codes), size):
            part = {(e, x): turn_repair.search(codes[k:k + size], copies[k:k + size], e, x) for e in ((0,) if k == 0 else range(4))
                    for x in ((turn_repair.END,) if k + size >= len(codes) else range(4))}
            part = {k: v for k, v in part.items() if v}
            places = {a: i for i, a in enumerate(sorted({v[1] for v in part.values()}))}
            found.append(part)
            tables.append({k: (v[0], places[v[1]]) for k, v in part.items()})
        path = turn_repair.joined_segments(tables)
        assert whole == (sum(f[p][0] for f, p in zip(found, path)), "".join(f[p][1] for f, p in zip(found, path)))


def test_search_stays_small_on_long_segments():
    rng = random.Random(4)
    for letters in ("u", "au", "uua", "sx", "dsuaxSUAX", "UA", "uuaaSX"):
        codes = "".join(rng.choice(letters) for _ in range(turn_repair.SEGMENT))
        for entry in range(4):
            assert turn_repair.search(codes, [1] * len(codes), entry)


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        out += [(conv, turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    return out


def expected(ids, rows):
    convs = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role.encode(), text.encode(), role, text))
    out = {}
    for conv, held in convs.items():
        held.sort()
        pairs, turns = [r[4:] for r in held], {r[1] for r in held if r[0]}
        faults, initials = fault_of(pairs), [r[0][:1] for r in pairs]
        cost, audit, rep = plain(pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(rep).encode()).hexdigest())
    return out


def result(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    rows = df.collect()
    out = {r[0]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_turn_repair"](spark, SF)) == expected({r[0] for r in rows}, damaged_rows(rows))


def test_odd_conversations(spark, monkeypatch):
    """Nulls, empty and long texts, ties, repeated rows, foreign roles, and segments of a few rows."""
    rng = random.Random(5)
    texts = [None, "", " \n", "Yes.", "No", "Why?\t", "é", "x" * 50_000 + "!", "Go!"]
    roles = ["user", "assistant", "system", "tool", "", None, "ua"]
    rows = [(conv if conv < 12 else None, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts), "c", 1, "n")
            for conv in range(13) for _ in range(rng.randint(1, 24))]
    rows += [(20, t, "user" if t % 2 else "assistant", f"{t}.", "c", 1, "n") for t in range(60)] + [(21, 0, "user", "Same.", "c", 1, "n")] * 400
    frame = spark.createDataFrame(rows, SCHEMA)
    plain_rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    ids = frame.select(frame.conv_id.alias("conv"))
    for size in (3, turn_repair.SEGMENT):
        monkeypatch.setattr(turn_repair, "SEGMENT", size)
        assert result(turn_repair.report(frame, ids)) == expected({r[0] for r in rows}, plain_rows)


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(turn_repair.report(none, none.select("conv"))) == {}
    ids = spark.createDataFrame([(7,), (None,)], "conv bigint")
    assert result(turn_repair.report(none, ids)) == {i: (0, 0, 0, 0, 0, 0, "", empty) for i in (7, None)}


def test_damage(spark):
    rows = [(c if c % 7 else None, t if t % 5 else None, "system" if t % 3 else None, "A. b! c?") for c in range(40) for t in range(8)]
    got = turn_repair.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, damaged_rows(rows)))


def test_plan_has_no_row_udf(spark):
    plan = QUERIES["op12_turn_repair"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))
