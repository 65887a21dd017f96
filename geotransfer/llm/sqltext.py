"""DuckDB texts of queries whose SQL is long. ``crc32`` is spelled out bit by bit."""

from __future__ import annotations


def repair_sql() -> str:
    """Damage, faults and the cheapest edits of a conversation: a fold over its rows that keeps, for each of the four states,
    the least (cost, audit) and the repaired text."""
    def to(state, letters, price, role=None, extra=""):
        # a row of the fold: cost, audit and repaired text after some edits from a state
        line = f" || {extra}" if extra else ""
        return f"{{'c': x.s{state}.c + {price}, 'a': x.s{state}.a || '{letters}', 'r': x.s{state}.r{line}}}"
    nl = "chr(10)"
    keep = f"({nl} || e.role || ':' || e.text)"
    user, bot = f"({nl} || 'user:' || e.text)", f"({nl} || 'assistant:' || e.text)"
    iu, ib = f"({nl} || 'user:')", f"({nl} || 'assistant:')"
    none = "{'c': 1000000000, 'a': '', 'r': ''}"
    def when(cond, item): return f"CASE WHEN {cond} THEN {item} ELSE {none} END"
    stays = "e.code <> 'd'"
    s0 = [to(0, "D", 4)]
    s1 = [to(1, "D", 4), when("e.base = 's'", to(0, "K", "e.cut", extra=keep))]
    s2 = [to(2, "D", 4)] + [when("e.base = 'u'", to(k, "K", "e.cut", extra=keep)) for k in (0, 1, 3)] + [
        when(stays, to(k, "R", "3 + e.cut", extra=user)) for k in (0, 1, 3)] + [
        when("e.base = 'u'", to(2, "IK", "3 + e.cut", extra=f"{ib} || {keep}")), when(stays, to(2, "IR", "6 + e.cut", extra=f"{ib} || {user}"))]
    s3 = [to(3, "D", 4), when("e.base = 'a'", to(2, "K", "e.cut", extra=keep)), when(stays, to(2, "R", "3 + e.cut", extra=bot))] + [
        when("e.base = 'a'", to(k, "IK", "3 + e.cut", extra=f"{iu} || {keep}")) for k in (0, 1, 3)] + [
        when(stays, to(k, "IR", "6 + e.cut", extra=f"{iu} || {bot}")) for k in (0, 1, 3)]
    fold = ", ".join(f"'s{k}': list_sort([{', '.join(s)}])[1]" for k, s in enumerate((s0, s1, s2, s3)))
    start = f"{{'s0': {{'c': 0, 'a': '', 'r': ''}}, 's1': {none}, 's2': {none}, 's3': {none}}}"
    return fr"""
WITH t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                          lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
k AS (SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)),
                                CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS pick FROM t),
d AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
             CASE pick WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN pick = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE pick <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
f AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS twice,
             CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS base,
             left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair, pos > 1 AS later FROM p),
g AS (SELECT *, NOT blank AND NOT twice AND last NOT IN ('.', '!', '?') AS cut FROM f),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated,
             count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list_reduce(list({{'code': CASE WHEN blank OR twice THEN 'd' ELSE base END, 'base': CASE WHEN blank OR twice THEN 'd' ELSE base END,
                 'cut': CASE WHEN cut THEN 3 ELSE 0 END, 'role': role, 'text': text}} ORDER BY pos),
                 lambda x, e: {{{fold}}}, {start}) AS z FROM g GROUP BY conv_id),
b AS (SELECT *, list_sort([{{'c': z.s0.c, 'a': z.s0.a, 'r': z.s0.r}},
                {{'c': z.s1.c + 6, 'a': z.s1.a || 'II', 'r': z.s1.r || {iu} || {ib}}},
                {{'c': z.s2.c + 3, 'a': z.s2.a || 'I', 'r': z.s2.r || {ib}}}, {{'c': z.s3.c, 'a': z.s3.a, 'r': z.s3.r}}])[1] AS best FROM c)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id"""


SPELLING_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t
      WHERE length(run) >= 7 GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM l),
k AS (SELECT run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
        lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)),
        CAST(4294967295 AS BIGINT)) AS h FROM x),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM k)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
s AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS stem FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM s a JOIN s b ON a.stem = b.stem AND a.i = b.i AND a.word <> b.word
      UNION SELECT s.word, s.n, w.word, w.n FROM s JOIN w ON s.stem = w.word
      UNION SELECT w.word, w.n, s.word, s.n FROM s JOIN w ON s.stem = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, {'m': -m, 'other': other}) AS other, max(m) AS m FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
      FROM w LEFT JOIN b ON w.word = b.word),
r AS (SELECT word, word AS root, 0 AS hop FROM f
      UNION ALL SELECT r.word, f.form, hop + 1 FROM r JOIN f ON r.root = f.word AND f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, hop) AS root FROM r GROUP BY word) e ON f.word = e.word"""
