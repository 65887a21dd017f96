"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most ``distance`` bits agree on one of ``distance + 1`` bit
blocks. Each block value is a top node of the index: all fingerprints below share these
bits. A task sorts the fingerprints of its top nodes by Gray rank, so neighbours share long
patterns, and builds a binary tree in which every node stores the bits that all fingerprints
below it have in common. A join walks pairs of nodes downwards. It adds up the differences
between bits that a level fixes anew, and drops the whole pair of groups as soon as the sum
passes ``distance``, or when both groups are known to be one component already.

A task sends at most one link per fingerprint and top node (a spanning forest), never the
pairs. Top nodes above ``unit`` fingerprints are dealt into salted parts, and each pair of
parts becomes a task unit, so the join stays whole. Components come from rounds of
contraction on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from geotransfer.llm.common import keyed, mapped, runs, tag_of, utf8
from geotransfer.session import materialize

FRONTIER = 1 << 19  # node pairs expanded at once
FLUSH = 100_000  # fingerprints gathered before their trees are joined


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of lower-cased word shingles: a bit is set if over half the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(),
                                                            ends[shingle - 1:].tolist())])
    n = len(raw) // 8
    # Counts per bit, in pieces so that a very long text needs no matrix of all its bits.
    total = np.zeros(64, np.int64)
    for a in range(0, n, 4096):
        total += np.unpackbits(np.frombuffer(raw[8 * a:8 * (a + 4096)], np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprint_task(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(fp.view(np.int64))],
                                             ["id", "tag", "fp"])
    return task


def _least(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after adding the links a-b to ``parent``."""
    while len(a):
        x, y = parent[a], parent[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


class Forest:
    """Trees over the fingerprints of several units, level by level; rows sorted by unit and Gray rank."""

    def __init__(self, fp: np.ndarray, unit: np.ndarray):
        self.fp = fp
        starts = np.flatnonzero(runs(unit))
        count = np.diff(np.append(starts, len(unit)))
        self.levels = []  # (all-ones bits, any-ones bits, first node of each unit, nodes of each unit)
        ones, anyone = fp, fp
        while True:
            self.levels.append((ones, anyone, starts, count))
            if count.max(initial=1) == 1:
                return
            higher = (count + 1) // 2
            first = np.concatenate([[0], np.cumsum(higher)[:-1]])
            u = np.repeat(np.arange(len(count)), higher)
            left = starts[u] + 2 * (np.arange(len(u)) - first[u])
            right = np.minimum(left + 1, starts[u] + count[u] - 1)
            ones, anyone = ones[left] & ones[right], anyone[left] | anyone[right]
            starts, count = first, higher

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left child, right child, and whether the right one exists, of nodes of ``level``."""
        _, _, first, _ = self.levels[level]
        _, _, below, n = self.levels[level - 1]
        u = np.searchsorted(first, node, "right") - 1
        j = node - first[u]
        left = below[u] + 2 * j
        return left, left + 1, 2 * j + 1 < n[u]

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the one component of a node's fingerprints, or -1 if they are of several."""
        out = [label]
        for level in range(1, len(self.levels)):
            node = np.arange(len(self.levels[level][0]))
            left, right, two = self.children(level, node)
            x = out[-1]
            both = x[np.where(two, right, left)]
            out.append(np.where(x[left] == both, both, -1))
        return out

    def components(self, distance: int) -> np.ndarray:
        n = len(self.fp)
        label = np.arange(n)
        unit = np.searchsorted(self.levels[0][2], label, "right") - 1
        for step in (1, 2, 3):  # Gray neighbours first: dense groups become one component early
            a = np.arange(n - step)
            near = (unit[a] == unit[a + step]) & (np.bitwise_count(self.fp[a] ^ self.fp[a + step]) <= distance)
            label = _least(label, a[near], a[near] + step)
        one = self.uniform(label)
        top = len(self.levels) - 1
        roots = np.flatnonzero(self.levels[0][3] > 1)
        stack = [(top, roots, roots, np.zeros(len(roots), np.uint8))]
        tested = 0
        while stack:
            level, a, b, acc = stack.pop()
            if len(a) > FRONTIER:
                for k in range(0, len(a), FRONTIER):
                    stack.append((level, a[k:k + FRONTIER], b[k:k + FRONTIER], acc[k:k + FRONTIER]))
                continue
            apart = (one[level][a] != one[level][b]) | (one[level][a] < 0)
            a, b, acc = a[apart], b[apart], acc[apart]
            if not len(a):
                continue
            if level == 0:
                label = _least(label, a, b)
                continue
            ones, anyone = self.levels[level][:2]
            shared = ~(ones[a] ^ anyone[a]) & ~(ones[b] ^ anyone[b])  # bits this level has added up already
            a0, a1, a2 = self.children(level, a)
            b0, b1, b2 = self.children(level, b)
            same = a == b
            yes = np.ones(len(a), bool)
            parts = [(a0, b0, yes), (a0, b1, b2), (a1, b0, a2 & ~same), (a1, b1, a2 & b2)]
            x = np.concatenate([p[0][p[2]] for p in parts])
            y = np.concatenate([p[1][p[2]] for p in parts])
            done = np.concatenate([shared[p[2]] for p in parts])
            acc = np.concatenate([acc[p[2]] for p in parts])
            ones, anyone = self.levels[level - 1][:2]
            fresh = ~(ones[x] ^ anyone[x]) & ~(ones[y] ^ anyone[y]) & ~done
            acc = acc + np.bitwise_count((ones[x] ^ ones[y]) & fresh)
            near = acc <= distance
            if level == 1:
                near &= x != y
            tested += len(x)
            stack.append((level - 1, x[near], y[near], acc[near]))
            if tested > 4 * FRONTIER:
                one, tested = self.uniform(label), 0
        return label


def _index_task(distance: int):
    """Rows sorted by unit and Gray rank in; one link per fingerprint and component out."""

    def links(fp: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        label = Forest(fp, unit).components(distance)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))],
                                          ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("block", "value", "part", "fp")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]) >= FLUSH:
                last = np.flatnonzero(runs(*held[:3]))[-1]  # the last unit may go on
                if last:
                    unit = np.cumsum(runs(*[h[:last] for h in held[:3]]))
                    yield links(held[3][:last].view(np.uint64), unit)
                    held = [h[last:] for h in held]
        if held is not None and len(held[0]):
            yield links(held[3].view(np.uint64), np.cumsum(runs(*held[:3])))

    return task


def near_links(fps: DataFrame, distance: int = 4, unit: int = 50_000) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``distance`` bits; ``fps`` has distinct ``fp``."""
    blocks = distance + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    tops = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", edges[k]).bitwiseAND(
        F.lit((1 << (edges[k + 1] - edges[k])) - 1)).alias("value")) for k in range(blocks)])
    routed = fps.select("fp", F.inline(tops))
    # At most blocks * 2^ceil(64 / blocks) top nodes exist: this table is bounded by a constant.
    parts = routed.groupBy("block", "value").count().select(
        "block", "value", F.ceil(F.col("count") / unit).cast("int").alias("parts"))
    cut = routed.join(F.broadcast(parts.where("parts > 1")), ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: t != own)))
    units = cut.select("block", "value", "fp", own.alias("own"), "parts", other.alias("other")).select(
        "block", "value", "fp", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(
            F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"))
    return mapped(_in_gray_order(units), _index_task(distance), "a bigint, b bigint")


def _in_gray_order(units: DataFrame) -> DataFrame:
    ranked = units.withColumn("rank", F.col("fp"))
    for s in (1, 2, 4, 8, 16, 32):
        ranked = ranked.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", s)))
    signless = F.col("rank").bitwiseXOR(F.lit(-(1 << 63)))  # orders a long like an unsigned one
    return (ranked.withColumn("rank", signless).repartition("block", "value", "part")
            .sortWithinPartitions("block", "value", "part", "rank").select("block", "value", "part", "fp"))


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): rounds of contraction to a neighbour of least random rank.

    A round sends each vertex to the least of itself and its neighbours under a hash seeded by
    the round, then renames the links. Ends at unequal roots never stay linked; the number of
    rounds grows with the logarithm of the vertices.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    found = materialize(edges.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v")))
    turn = 0
    while not edges.isEmpty():
        rank = F.xxhash64(F.col("b"), F.lit(turn))
        best = edges.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("to"))).alias("best"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(turn)).alias("r"), F.col("a").alias("to"))
        step = materialize(best.select("a", F.least(own, F.col("best"))["to"].alias("to")))
        found = materialize(found.join(step, found.root == step.a, "left").select(
            "v", F.coalesce("to", "root").alias("root")))
        left = edges.join(step, "a").select(F.col("to").alias("x"), "b")
        moved = left.join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        edges = materialize(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        turn += 1
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    distance: int = 4, unit: int = 50_000) -> DataFrame:
    """``id``, ``tag``, ``fp`` (long), ``component_id`` (smallest id reachable) and ``root`` (a fingerprint of it).

    Texts without words (null, empty, white space) have fingerprint zero and are linked like
    any other. Null ids take part but name a component only if it holds no other id. Repeated
    rows give repeated rows with one component. An empty table gives an empty table.
    """
    docs = keyed(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    prints = materialize(mapped(docs, _fingerprint_task(shingle), f"id {id_type}, tag binary, fp bigint"))
    least = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(least.select("fp"), distance, unit))
    rooted = least.join(roots, least.fp == roots.v, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(of_fp, "fp").select("id", "tag", "fp", "component_id", "root")


def stage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id (of equal ids, the
    smallest text checksum); rows equal in both stay together. A group of null ids only keeps one checksum."""
    found = near_duplicates(df, id_col, text_col)
    first = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    # Ids are nearly always unique; the aggregate settles repeated ids inside a component.
    kept = first.groupBy("root", "id").agg(F.min("tag").alias("tag")).select("id", "tag").distinct()
    docs = df.select("*", tag_of(F.col(f"`{text_col}`")).alias("__tag"))
    kept = kept.select(F.col("id").alias("__id"), F.col("tag").alias("__kept"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (docs["__tag"] == kept["__kept"]), "left_semi"
                     ).select(*[docs[c] for c in df.columns])
