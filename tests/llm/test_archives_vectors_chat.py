import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotransfer.llm import chat_windows, pivot_index, warc_zip

PAGES = "page_id bigint, url string, html string, digest string, size string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(3)


def page_rows():
    big = "<p>é same</p>" * 20
    return [(9, "http://a", big), (4, "http://b\r\nX: y", big), (7, None, big), (None, "http://c", big), (4, "http://d", big),
            (1, "u", "short"), (2, "u", "short"), (3, "u", None), (5, "u", ""), (6, "u", "x" * 200_000),
            (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100), (None, "u", "only null ids" * 20)]


@pytest.mark.parametrize("roll", [32 << 20, 600])
def test_archives_round_trip(spark, tmp_path, monkeypatch, roll):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", roll)
    rows = page_rows()
    manifest = warc_zip.write_packages(pages(spark, rows), f"file://{tmp_path}/w")
    got = warc_zip.read_packages(manifest).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("records")).first()[0]
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response",
                     str(f) if revisit else "None", None if revisit else b))
    key = lambda t: (t[0], t[2], t[3], t[4], t[5] or b"")
    have = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to),
             None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {r.url for r in got if r.page_id == 4} == {"http://b%0D%0AX: y", "http://d"}


def test_no_pages_no_package(spark, tmp_path):
    assert warc_zip.write_packages(pages(spark, []), f"file://{tmp_path}/e").count() == 0


def test_packages_are_zip_files():
    raw = warc_zip.package([("a/b", b"hello"), ("c", b"")])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read("a/b") == b"hello" and z.namelist() == ["a/b", "c"]


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 inside"])
def test_directory_of_other_writers(comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", b"x" * 50)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"y" * 70)
        z.writestr("packed", b"z" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    raw = out.getvalue()
    m = {x.name: x for x in warc_zip.directory(io.BytesIO(raw), len(raw))}
    assert raw[m["plain"].offset:m["plain"].offset + m["plain"].size] == b"x" * 50
    assert raw[m["wide"].offset:m["wide"].offset + m["wide"].size] == b"y" * 70
    assert m["plain"].stored and m["wide"].stored and not m["packed"].stored
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"no archive"), 10)


def vectors(seed=1, n=400, dims=12):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(8, dims))
    rows = [(i, (centre[i % 8] + 0.2 * r.normal(size=dims)).astype("f4").tolist()) for i in range(n)]
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(60)]  # a vector that many rows hold
    return rows + [(2000, None), (2050, [None] * dims), (2100, [float("nan")] + [0.0] * (dims - 1)), (None, same),
                   (2150, [float("inf")] * dims), (2200, [0.0] * dims), (2250, []), (2300, [1.0, -1.0])]


def brute_top(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out |= {(q, rank, i, -neg) for rank, (neg, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("block,pivots,rings", [(8192, 24, 8), (16, 5, 3)])
def test_top_k_is_brute_force(spark, block, pivots, rings):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, tag string, dist double")
    got = pivot_index.top_k(df.repartition(3), F.col("id") % 50 == 0, block=block, pivots=pivots, rings=rings)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    q = F.col("id") % 50 == 0
    assert pivot_index.top_k(spark.createDataFrame([], schema), q).count() == 0
    assert pivot_index.top_k(spark.createDataFrame([(1, [1.0])], schema), q).count() == 0
    two = spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [3.0, 1.0])], schema)
    assert [tuple(r) for r in pivot_index.top_k(two, q).collect()] == [(50, 1, 51, 5 * 256 * 256)]


def test_far_rings_are_pruned():
    """A ring whose least possible distance passes the k-th best one is never routed to."""
    rings = pivot_index.Rings([{"pivot": 0, "ring": 0, "low": 0.0, "high": 1.0, "n": 5},
                               {"pivot": 1, "ring": 0, "low": 0.0, "high": 1.0, "n": 5}], np.array([[0.0, 0, 0], [50.0, 0, 0]]), 8)
    _, bound = rings.bounds(np.array([[1.0, 0.0]]))
    assert bound[0, 0] == 0 and bound[0, 1] == 48


CHAT = "conv_id bigint, turn bigint, role string, text string, w string, pos string, first string"


def chat_rows(seed=2):
    r = random.Random(seed)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<<REPEAT>>", "&lt;", "&amp;", "&", "<", "[", "é", "plain words ", "\n", "</", "s>"]
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "Be kind."))
        for t in range(1, r.randint(2, 60)):
            text = "".join(r.choice(bits) for _ in range(r.randint(0, 40))) * r.choice([1, 1, 1, 30])
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]  # several chunks
    return rows + [(60, None, None, None), (60, 1, "assistant", None), (60, 1, "assistant", None), (None, 1, "user", "x"),
                   (None, 2, "assistant", "y" * 9000), (61, 5, "a[/INST]b", "odd role")]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "a", "b", "c") for x in rows], CHAT).repartition(4)


def test_chat_round_trip(spark):
    rows = chat_rows()
    out = {r.conv: r for r in chat_windows.digests(chat_windows.windows(frame(spark, rows))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c


def written(text):
    text = text.replace("&", "&amp;")
    for c in chat_windows.CONTROLS:
        text = text.replace(c, ("&lt;" if c[0] == "<" else "&lb;") + c[1:])
    return text


def written_tokens(window):
    return sum((len(written(t.text)) + 3) // 4 + 4 for t in window.turns)


def test_long_system_turns_and_escapes_stay_within_the_budget(spark):
    rows = []
    for conv, (system, text) in enumerate([(6_000, "a" * 300), (7_100, "b" * 40), (9_000, "c" * 900), (0, "[INST]" * 40), (2_000, "&" * 200)]):
        rows += [(conv, 0, "system", "s" * system)] if system else []
        rows += [(conv, k, "assistant" if k % 2 else "user", f"{k} {text}") for k in range(1, 60)]
    out = chat_windows.parsed(chat_windows.windows(frame(spark, rows))).collect()
    assert max(written_tokens(r) for r in out if r.conv != 2 or r.turns[0].role != "system") <= chat_windows.BUDGET
    assert all(sum(t.role == "system" and not t.again for w in out if w.conv == c for t in w.turns) == 1 for c in (0, 1, 2, 4))
    for r in out:
        if r.conv in (0, 1, 4) and all(t.role != "system" or t.again for t in r.turns):
            assert r.turns[0].role == "system"
    counted = frame(spark, rows).selectExpr("*", "CAST(100 AS INT) AS counted")
    name = {c: c for c in ("conv_id", "turn", "role", "text")}
    per = chat_windows.parsed(chat_windows.windows(counted, **dict(zip(("conv", "turn", "role", "text"), name)), n_tokens="counted")).collect()
    assert max(len(r.turns) for r in per) * 100 <= chat_windows.BUDGET and len(per) < len(out)


def test_windows_hold_budget_system_turn_and_history(spark):
    rows = chat_rows()
    out = chat_windows.parsed(chat_windows.windows(frame(spark, rows))).collect()
    per, system = {}, {c for c, _, role, _ in rows if role == "system"}
    for r in out:
        per.setdefault(r.conv, []).append(r)
        assert written_tokens(r) <= chat_windows.BUDGET or sum(not t.again for t in r.turns) == 1
        assert len(r.targets) == sum(t.role == "assistant" and not t.again for t in r.turns)
    assert max(map(len, per.values())) > 3
    for c, ws in per.items():
        ws.sort(key=lambda r: r.w)
        assert not any(t.again for t in ws[0].turns)
        for w in ws[1:]:
            assert (w.turns[0].role == "system" and w.turns[0].again) == (c in system)
            assert sum(t.again and t.role != "system" for t in w.turns) <= chat_windows.HISTORY


def test_no_python_in_the_chat_plan(spark):
    plan = chat_windows.digests(chat_windows.windows(frame(spark, chat_rows())))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_of_no_rows(spark):
    assert chat_windows.windows(frame(spark, [])).count() == 0
