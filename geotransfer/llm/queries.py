"""Registered queries of this subpackage with their DuckDB texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geotransfer.llm import (byte_bpe, chat_windows, line_dedup, packing, pivot_index, quality_rules, simhash_index,
                             source_mix, spelling_groups, sqltext, substring_dedup, token_files, turn_repair, warc_zip)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op1_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
dup AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM win),
cov AS (SELECT w.doc_id, w.word, w.i, coalesce(max(CAST(again AS INT)) OVER (
          PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
        FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id AND w.i = dup.i)
SELECT d.doc_id, CAST(len(any_value(d.words)) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id GROUP BY d.doc_id""")
def op1(spark, sf):
    out = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_quality_rules")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    out = quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf, "labels")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


@query("op3_simhash_near_dedup")
def op3(spark, sf):
    out = simhash_index.near_duplicates(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


@query("op9_line_dedup", r"""
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(many.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (many.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN many ON k.key = many.key GROUP BY doc_id""")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_packing")
def op5(spark, sf):
    out = packing.pack(table(spark, sf, "documents"), _vocabulary("word_bpe_49k.json"))
    return out.drop("ids").withColumnRenamed("id", "doc_id")


@query("op7_token_files")
def op7(spark, sf):
    folder = token_files.folder_for(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), folder, _vocabulary("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, folder)).withColumnRenamed("id", "doc_id")


@query("op8_byte_bpe")
def op8(spark, sf):
    import public_tokenizers

    path = _vocabulary("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(coded, path).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256",
                                               F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_warc_zip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def op4(spark, sf):
    manifest = warc_zip.write_packages(table(spark, sf, "pages"), token_files.folder_for(spark, "warc"))
    return warc_zip.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_pivot_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS iv FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.iv, v.iv) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op6(spark, sf):
    return pivot_index.top_k(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


_ESC = ("replace(replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), "
        "'<<REPEAT>>', '&lt;<REPEAT>>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]')")


@query("op10_chat_windows", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, (length({_ESC.format('text')}) + 3) // 4 + 4 AS n, row_number() OVER o AS pos FROM c
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM n),
h AS (SELECT conv_id AS c, n AS system FROM u WHERE pos = 1 AND role = 'system' AND n <= {chat_windows.BUDGET * 7 // 8}),
z AS (SELECT u.*, system IS NOT NULL AS led, ({chat_windows.BUDGET} - coalesce(system, 0)) // 8 AS reserve,
        {chat_windows.BUDGET} - coalesce(system, 0) - 3 * (({chat_windows.BUDGET} - coalesce(system, 0)) // 8) AS stride
      FROM u LEFT JOIN h ON conv_id = c),
w AS (SELECT *, 2 * ((upto - n) // stride) + CASE WHEN (upto - 1) // stride > (upto - n) // stride AND n > reserve THEN 1 ELSE 0 END AS w,
        24 - 4 + length({_ESC.format('role')}) + length({_ESC.format('text')}) AS chars FROM z),
f AS (SELECT conv_id, w, min(pos) AS first FROM w GROUP BY ALL HAVING min(pos) > 1),
r AS (SELECT w.conv_id, sum(w.chars + 10) AS chars FROM f JOIN w ON w.conv_id = f.conv_id
      AND ((w.pos = 1 AND w.led)
           OR (w.pos < f.first AND w.pos >= f.first - {chat_windows.HISTORY} AND w.n <= w.reserve))
      GROUP BY w.conv_id)
SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(w.chars) + coalesce(any_value(r.chars), 0) AS BIGINT) AS formatted_chars
FROM w LEFT JOIN r ON w.conv_id = r.conv_id GROUP BY w.conv_id""")
def op10(spark, sf):
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_windows.digests(chat_windows.windows(turns)).withColumnRenamed("conv", "conv_id")


@query("op11_source_mix", rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS own, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
f AS (SELECT 0 AS round, CAST(sum(own) AS HUGEINT) AS words, CAST(sum(w) AS HUGEINT) AS rest FROM s
      UNION ALL
      SELECT any_value(f.round) + 1, (SELECT sum(own) FROM s) - coalesce(sum(3 * own) FILTER (3 * own * f.rest < w * f.words), 0),
             (SELECT sum(w) FROM s) - coalesce(sum(w) FILTER (3 * own * f.rest < w * f.words), 0)
      FROM s, f WHERE f.round < 40 GROUP BY ALL HAVING any_value(f.rest) > 0),
g AS (SELECT words, rest FROM f ORDER BY round DESC LIMIT 1),
t AS (SELECT source, own, CASE WHEN 3 * own * rest < w * words THEN CAST(3 * own AS DOUBLE)
               ELSE CAST(w * words AS DOUBLE) / CAST(rest AS DOUBLE) END AS target,
             (CAST('0x' || substr(md5('{source_mix.SEED}:' || coalesce('=' || source, 'null')), 1, 5) AS BIGINT) + 0.5::DOUBLE)
             / 1048576 AS u FROM s, g),
p AS (SELECT doc_id, size, own, target, u, CASE WHEN own > 0 THEN target / own ELSE 0 END AS r,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, own AS source_size, target,
       size * CAST(floor(k * r + u) - floor((k - 1) * r + u) AS BIGINT) AS taken FROM p""")
def op11(spark, sf):
    out = source_mix.mixed(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op12_turn_repair", sqltext.repair_sql())
def op12(spark, sf):
    turns = table(spark, sf, "conversations")
    out = turn_repair.report(turn_repair.damaged(turns), turns.select(F.col("conv_id").alias("conv")))
    return out.withColumnRenamed("conv", "conv_id")


@query("op13_spelling_groups", sqltext.SPELLING_SQL)
def op13(spark, sf):
    words = spelling_groups.word_counts(table(spark, sf, "documents"), thinned=31)
    return spelling_groups.grouped(words).select("word", "form", "root", "n", "n_near", "form_n")
