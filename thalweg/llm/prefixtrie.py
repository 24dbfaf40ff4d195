"""The trie of the prefixes of conversations, with sums over its subtrees by heavy-path decomposition.

Turns are numbered by a sort over ranges, so that a long conversation lies in several tasks: each numbers its own part, and what
precedes a part is added afterwards (there is at most one such conversation for each border of ranges). A prefix
is known by two polynomial sums over 128-bit digests of its turns, modulo 2^64, which can be shifted and put behind each other:
that rebuilds a conversation (the first turns of another one, then its own after as many) without gathering its turns.

The heavy child of a node is that of most members, ties by key. Members add up to those of the parent at most, so a way down
meets a light child no more often than the logarithm of the number of conversations. A heavy path ends in a leaf, and is
the lower end of the leaf's smallest conversation: from its last light node on. So paths and their levels (light nodes above
them) come from the rows of those conversations, without a walk. Then, level by level from below, sums are added up along each path from
its end (in blocks, so that no window holds more than BLOCK nodes or a row for each block), and what the top of a path has is
attached to its parent on the level above.

Ids of the conversations that end in a node are sorted by ranges, written out in pieces of text, and digested piece by piece
in a stream, so that a node in which a third of all conversations end costs no memory.

Cases: null role or text counts as ''; turns of equal number stand by role, then text; repeated rows are turns of their own; rows
with a null conv_id belong to no conversation and are left out; other columns are left out; an empty table has the
root alone, with no members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import mix64

#: Turns of another conversation that a rebuilt one begins with, less than; conversations that share one.
HEAD, SHARED = 6, 100
#: Nodes of a path that one window holds; ids in a piece of text.
BLOCK, PIECE = 4096, 2048
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Key of the root. No prefix has it, as keys of those are odd in their first part.
ROOT = (0, 0)
_KEY = ["k1", "k2"]


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base to the powers n, modulo 2^64; base is odd, so that n may be negative."""
    out, square = np.ones(len(n), "uint64"), np.where(n < 0, np.uint64(pow(base, -1, 1 << 64)), np.uint64(base))
    left = np.abs(n)
    while left.any():
        out = np.where(left & 1, out * square, out)
        square, left = square * square, left >> 1
    return out


def _keys(sums: list[np.ndarray], depth: np.ndarray) -> list[np.ndarray]:
    """The key of a prefix from its sums and its depth; that of the root for depth 0."""
    d = depth.astype("uint64")
    one, two = mix64(sums[0] + d) | np.uint64(1), mix64(sums[1] ^ mix64(d))
    return [np.where(depth == 0, 0, x.view("int64")) for x in (one, two)]


def numbered_turns(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), size (code points of the text), p1, p2: sums over the turns before, q1, q2: those with the turn."""
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = given.withColumn("begins", F.substring("text", 1, 32)).repartitionByRange("conv_id", "turn", "role", "begins").sortWithinPartitions("conv_id", "turn", "role", "text")
    sorted_ = sorted_.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, carried = None, 0, np.zeros(2, "uint64")
        for b in batches:
            conv = b.column("conv_id").to_numpy()
            if not len(conv):
                continue
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            raw = [xxhash.xxh3_128_intdigest(f"{len(r)} {r}{t}".encode("utf-8", "surrogatepass")) for r, t in zip(roles, texts, strict=True)]
            size = np.fromiter(map(len, texts), "int64", len(texts))
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last is None or conv[0] != last
            first = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: the conversation goes on
            i = np.arange(len(conv)) - np.concatenate([[-n], first])[group]
            sums = []
            for j, base in enumerate(_BASES):
                term = np.array([x >> 64 * j & (1 << 64) - 1 for x in raw], "uint64") * _power(base, i)
                total = np.zeros(len(conv) + 1, "uint64")
                np.cumsum(term, out=total[1:])
                start = np.append(~carried[j : j + 1] + np.uint64(1), total[first])[group]
                sums += [total[:-1] - start, total[1:] - start]
            last, n, carried = conv[-1], int(i[-1]) + 1, np.array([sums[1][-1], sums[3][-1]], "uint64")
            columns = [sums[0], sums[2], sums[1], sums[3]]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("conv_id"), pa.array(i), pa.array(size), *(pa.array(x.view("int64")) for x in columns)], ["part", "conv_id", "i", "size", "p1", "p2", "q1", "q2"])

    parts = scratch.save(sorted_.mapInArrow(run, "part int, conv_id long, i long, size long, p1 long, p2 long, q1 long, q2 long"), "parts")
    # conversations that go across borders of ranges: one for each border at most
    across = parts.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    ends = across.select("low").union(across.select("high")).groupBy("low").count().where("count > 1").select(F.col("low").alias("conv_id"))
    pieces = parts.join(F.broadcast(ends), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("q1", "i").alias("q1"), F.max_by("q2", "i").alias("q2"))
    before: dict[tuple[int, int], tuple[int, ...]] = {}
    state: tuple[int, ...] = (0, 0, 0)
    conv = None
    for r in pieces.orderBy("conv_id", "part").collect():  # two rows for each range at most
        if r.conv_id != conv:
            conv, state = r.conv_id, (0, 0, 0)
        before[r.conv_id, r.part] = state
        state = state[0] + r.n, *((state[1 + j] + (q % 2**64) * pow(base, state[0], 1 << 64)) % 2**64 for j, (base, q) in enumerate(zip(_BASES, (r.q1, r.q2))))
    later = {key: x for key, x in before.items() if x[0]}
    if not later:
        return parts.drop("part")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, part = b.column("conv_id").to_numpy(), b.column("part").to_numpy()
            i, own = b.column("i").to_numpy().copy(), {c: b.column(c).to_numpy().view("uint64").copy() for c in ("p1", "p2", "q1", "q2")}
            for (c, p), (n, s1, s2) in later.items():
                at = (conv == c) & (part == p)
                if at.any():
                    i[at] += n
                    for name, x in own.items():
                        j = int(name[1]) - 1
                        x[at] = x[at] * np.uint64(pow(_BASES[j], n, 1 << 64)) + np.uint64((s1, s2)[j])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(i), b.column("size"), *(pa.array(x.view("int64")) for x in own.values())], ["conv_id", "i", "size", *own])

    return parts.mapInArrow(shifted, "conv_id long, i long, size long, p1 long, p2 long, q1 long, q2 long")


def prefixes(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each turn of each rebuilt conversation: conv_id, depth, size, k1, k2, u1, u2 (keys of the prefix that ends with it,
    and of the one before), last; and a row for each conversation: conv_id, total (its turns)."""
    turns = scratch.save(numbered_turns(scratch, conversations), "turns")
    heads = turns.where(F.col("i") < HEAD - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "size", "q1", "q2"))).alias("head"))  # HEAD - 1 rows at most
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    mod = F.col("conv_id") - F.col("conv_id") % SHARED
    each = counts.join(heads, "conv_id").select("conv_id", "n", "head", mod.alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int").alias("h"))
    lent = heads.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("donor"), F.col("head").alias("lent"))
    each = each.join(lent, "donor", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(lent.schema["lent"].dataType)), F.lit(1), F.col("h")))
    zero = F.lit(0).cast("long")
    at = lambda a, n, c: F.when(n > 0, F.element_at(a, F.greatest(n, F.lit(1)))[c]).otherwise(zero)  # noqa: E731  sums of n turns
    each = scratch.save(each.select("conv_id", "h", F.size("lent").alias("g"), "lent", (F.size("lent") + F.greatest(F.col("n") - F.col("h"), zero)).alias("total"), *(at("lent", F.size("lent"), q).alias(f"d{q}") for q in ("q1", "q2")), *(at("head", F.least("h", F.size("head")), q).alias(f"o{q}") for q in ("q1", "q2"))), "conversations")
    first = each.select("conv_id", "total", F.posexplode("lent").alias("i", "t"), "lent").select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "total", F.col("t.size").alias("size"), *(at("lent", F.col("i"), q).alias(p) for p, q in (("p1", "q1"), ("p2", "q2"))), F.col("t.q1").alias("q1"), F.col("t.q2").alias("q2"), zero.alias("shift"), *(zero.alias(x) for x in ("dq1", "dq2", "oq1", "oq2")))
    own = turns.join(each.select("conv_id", "h", "g", "total", "dq1", "dq2", "oq1", "oq2"), "conv_id").where("i >= h")
    own = own.select("conv_id", (F.col("g") + F.col("i") - F.col("h") + 1).cast("long").alias("depth"), "total", "size", "p1", "p2", "q1", "q2", (F.col("g") - F.col("h")).cast("long").alias("shift"), "dq1", "dq2", "oq1", "oq2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in b.schema.names}
            keys = []
            for less, names in ((0, "q"), (1, "p")):
                sums = []
                for j, base in enumerate(_BASES, 1):
                    d, o, s = (x[c].view("uint64") for c in (f"dq{j}", f"oq{j}", f"{names}{j}"))
                    sums.append(d + (s - o) * _power(base, x["shift"]))
                keys += _keys(sums, x["depth"] - less)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), b.column("size"), *map(pa.array, keys), pa.array(x["depth"] == x["total"])], ["conv_id", "depth", "size", "k1", "k2", "u1", "u2", "last"])

    rows = first.select(*own.columns).union(own).mapInArrow(run, "conv_id long, depth long, size long, k1 long, k2 long, u1 long, u2 long, last boolean")
    return scratch.save(rows, "prefixes"), each.select("conv_id", "total")


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends: k1, k2, conv_id. For each key the SHA-256 of its ids in ascending order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, conv = (b.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.ones(len(conv), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            cut = np.flatnonzero(new).tolist()
            out = [s for i, j in zip(cut, [*cut[1:], len(conv)]) for s in range(i, j, PIECE)]
            text = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(out, [min(s + PIECE, e) for s, e in zip(out, [*out[1:], len(conv)])])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[out]), pa.array(k2[out]), pa.array(conv[out]), pa.array(text, pa.string())], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done: list[tuple[int, int, str]] = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [state.hexdigest()]})

    cut = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").select(*_KEY, "conv_id").mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return cut.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").select(*_KEY, "ids").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _along(paths: DataFrame, columns: list[str]) -> DataFrame:
    """path, depth and more: each of the columns as its sum over this node and all below it on its path."""
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    below = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    sums = paths.groupBy("path", block).agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    sums = sums.select("path", "block", *(F.coalesce(F.sum(f"__{c}").over(below), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = W.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = paths.withColumn("block", block).join(sums, ["path", "block"])
    others = [c for c in paths.columns if c not in columns]
    return rows.select(*others, *((F.sum(c).over(inside) + F.col(f"__{c}")).cast("long").alias(c) for c in columns))


def _same(left: str, right: str) -> Column:
    return (F.col(f"{left}1") == F.col(f"{right}1")) & (F.col(f"{left}2") == F.col(f"{right}2"))


def heavy_paths(scratch: Scratch, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes: k1, k2, u1, u2 (parent), conv_id, depth, n_convs, n_children; rows: conv_id, k1, k2 of all prefixes. Returns each
    node's path (the conversation of its leaf), level, and whether it is the path's top."""
    kids = nodes.where("depth > 0")
    heavy = kids.groupBy("u1", "u2").agg(F.max(F.struct("n_convs", "k1", "k2")).alias("h"))
    marked = kids.join(heavy.select(F.col("h.k1").alias("k1"), F.col("h.k2").alias("k2"), F.lit(False).alias("light")), _KEY, "left")
    marked = marked.select(*_KEY, "depth", F.coalesce("light", F.lit(True)).alias("light"))
    leaves = nodes.where("n_children = 0 and depth > 0").select(F.col("conv_id").alias("path"))
    ways = rows.join(leaves, F.col("conv_id") == F.col("path"), "left_semi").select(F.col("conv_id").alias("path"), *_KEY)
    ways = scratch.save(ways.join(marked, _KEY), "ways")
    tops = ways.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("top"), F.sum(F.col("light").cast("int")).alias("level"))
    paths = ways.join(tops, "path").where("depth >= top").select(*_KEY, "path", "level", (F.col("depth") == F.col("top")).alias("is_top"))
    # the root is on the path of level 0; where there is no other node, it is one by itself
    of_root = tops.where("level = 0").select("path").union(nodes.where("depth = 0 and n_children = 0").select(F.coalesce("conv_id", F.lit(-1))))
    return paths.union(of_root.select(F.lit(ROOT[0]).cast("long"), F.lit(ROOT[1]).cast("long"), "path", F.lit(0).cast("long"), F.lit(True)))


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text and any more columns. Returns a row for each node: conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(spark, "prefixtrie")
    rows, each = prefixes(scratch, conversations)
    made = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.first("u1").alias("u1"), F.first("u2").alias("u2"))
    key = [F.lit(x).cast("long").alias(k) for k, x in zip(_KEY, ROOT)]
    root = each.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).select(*key, "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"))
    made = scratch.save(made.union(root), "made")
    kids = made.where("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.save(made.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    paths = heavy_paths(scratch, nodes, rows)
    own = nodes.select(*_KEY, "u1", "u2", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), (F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("size")).alias("saved_tokens"))
    sums = ["n_leaves", "saved_tokens"]
    placed = own.join(paths, _KEY).select(*own.columns, "path", "level", "is_top")
    placed.write.partitionBy("level").parquet(scratch.path("placed"))
    placed = spark.read.schema(placed.schema).parquet(scratch.path("placed"))
    settled: DataFrame | None = None
    for level in range(placed.agg(F.max("level")).first()[0], -1, -1):  # logarithmic in the number of conversations
        here = placed.where(F.col("level") == level).drop("level")
        if settled is not None:
            given = settled.where((F.col("level") == level + 1) & F.col("is_top")).groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
            here = here.join(given, _KEY, "left").select(*(c for c in here.columns if c not in sums), *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums))
        done = _along(here, sums).select(*_KEY, "u1", "u2", "is_top", *sums, F.lit(level).cast("long").alias("level"))
        settled = scratch.add(done, "settled")
    ends = rows.where("last").select(*_KEY, "conv_id").union(each.where("total = 0").select(*key, "conv_id"))
    over = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(settled.select(*_KEY, *sums), _KEY).join(ends_digests(ends), _KEY, "left").join(over, _same("u", "a"), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
