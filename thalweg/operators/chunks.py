"""Forests cut into chunks of neighbouring ids. Most links stay within a chunk, and are followed in a task; what goes on in other
chunks starts at entries, the nodes that a link from another chunk leads to, so only these are left for joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FractionalType, LongType, StructType

from ..functions.lineage import cut

#: Ids of a chunk.
SIZE = 1 << 18


def of(node: str) -> Column:
    return F.shiftright(node, SIZE.bit_length() - 1)


def entries(links: DataFrame) -> DataFrame:
    """links: node, to. chunk, node: what is linked to from another chunk."""
    return links.where(of("to") != of("node")).select(F.col("to").alias("node")).distinct().select(of("node").alias("chunk"), "node")


class _Chunk:
    """node in ascending order, up (the place of what each is linked to, -1 where a root or outside) and to (that one, where it is
    outside, else null)."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.sort_by("node")
        self.node, linked = self.rows["node"].to_numpy(), self.rows["to"]
        self.n, goes = len(self.node), linked.is_valid().to_numpy()
        to = linked.fill_null(-1).to_numpy()
        self.up = np.where(goes, self.at(to), -1)
        self.out = np.where(goes & (self.up < 0), to, -1)
        self.leaves = goes & (self.up < 0)

    def at(self, nodes: np.ndarray) -> np.ndarray:
        """Places of nodes, -1 of those that are not here."""
        i = np.minimum(np.searchsorted(self.node, nodes), self.n - 1)
        return np.where(self.node[i] == nodes, i, -1)

    def ends(self, *sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The place where the way of each ends here, and sums along it, that of the end left out. Where it never does, the place is
        one that has a link."""
        at, sums = np.where(self.up < 0, np.arange(self.n), self.up), [np.where(self.up < 0, 0, s) for s in sums]
        for _ in range(self.n.bit_length() + 1):
            if (self.up[at] < 0).all():
                break
            sums, at = [s + s[at] for s in sums], at[at]
        return at, sums


def _tasks(chunked: DataFrame, more: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(chunk, rows of `more` with its number), for each chunk that has rows."""

    def each(rows: pa.Table, told: pa.Table) -> pa.Table:
        return work(_Chunk(rows), told) if len(rows) else pa.table({f.name: pa.array([], f.type) for f in kept})

    kept = _arrow(schema)
    return chunked.groupBy("chunk").cogroup(more.groupBy("chunk")).applyInArrow(each, schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def followed(links: DataFrame) -> DataFrame:
    """links: node, to, weight. node, root, total: where the way of each within its chunk ends, and the weights up to there; next:
    the node that it goes on to in another chunk, at the cost of `total` too; root is null where it goes round."""

    def work(rows: pa.Table) -> pa.Table:
        c = _Chunk(rows)
        weight = c.rows["weight"].to_numpy()
        at, (total,) = c.ends(weight)
        round_ = c.up[at] >= 0
        total = total + np.where(c.leaves[at], weight[at], 0)
        return pa.table({"node": c.node, "root": pa.array(c.node[at], mask=round_), "total": total, "next": pa.array(c.out[at], mask=~c.leaves[at] | round_)})

    return links.select("node", "to", "weight", of("node").alias("chunk")).groupBy("chunk").applyInArrow(work, "node long, root long, total long, next long")


_JOIN = {"sum": np.add, "min": np.fmin, "max": np.maximum}  # NaN is the largest


def _gathered(c: _Chunk, values: list[tuple[np.ndarray, np.ndarray]], kinds: list[str]) -> None:
    """Adds to each what lies above it here: values and whether there are any, in place."""
    _, (depth,) = c.ends(np.ones(c.n, "int64"))
    order = np.argsort(-depth, kind="stable")
    order = order[: int((depth > 0).sum())]
    for some in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        for (v, known), kind in zip(values, kinds):
            if kind == "sum":
                np.add.at(v, c.up[some], v[some])
            else:
                given = some[known[some]]
                fresh = given[~known[c.up[given]]]
                v[c.up[fresh]] = v[fresh]
                _JOIN[kind].at(v, c.up[given], v[given])
            known[c.up[some[known[some]]]] = True


def _values(rows: pa.Table, names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(rows[n].fill_null(0).to_numpy().copy(), rows[n].is_valid().to_numpy().copy()) for n in names]


def totals(rows: DataFrame, kinds: dict[str, str], rest: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """rows: node, to and columns named by kinds (sum, min or max; null counts as nothing). node and those columns over all that
    is linked to each, itself included. rest(links, values) does the same for entries, whose own values are what comes in from
    other chunks. None where a way goes round."""
    for n, k in kinds.items():
        kind = rows.schema[n].dataType
        if k == "sum":
            rows = rows.withColumn(n, F.col(n).cast(DoubleType() if isinstance(kind, FractionalType) else LongType()))
    names, how = list(kinds), list(kinds.values())
    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    chunked = rows.select("node", "to", *names, of("node").alias("chunk"))
    shape = f"node long, to long, kind int, {fields}"
    types = _arrow(shape)

    def told(node, to, kind: int, values) -> pa.Table:
        return pa.table({"node": node, "to": to, "kind": np.full(len(node), kind, "int32"), **values}).cast(types)

    def first(c: _Chunk, entered: pa.Table) -> pa.Table:
        """kind 0: what goes from here to a node elsewhere; 1: links from entry to entry; 2: a way goes round."""
        at, _ = c.ends()
        if (c.up[at] >= 0).any():
            return told([0], [0], 2, {n: pa.nulls(1, types.field(n).type) for n in names})
        values = _values(c.rows, names)
        _gathered(c, values, how)
        given = told(c.out[c.leaves], pa.nulls(int(c.leaves.sum()), pa.int64()), 0, {n: pa.array(v[c.leaves], mask=~k[c.leaves]) for n, (v, k) in zip(names, values)})
        here = c.at(entered["node"].to_numpy()) if len(entered) else np.empty(0, "int64")
        here = here[here >= 0]
        links = told(c.node[here], pa.array(c.out[at[here]], mask=~c.leaves[at[here]]), 1, {n: pa.nulls(len(here), types.field(n).type) for n in names})
        return pa.concat_tables([given, links])

    def second(c: _Chunk, come: pa.Table) -> pa.Table:
        values = _values(c.rows, names)
        if len(come):
            place = c.at(come["node"].to_numpy())
            for (v, known), (w, has), kind in zip(values, _values(come, names), how):
                i, w = place[(place >= 0) & has], w[(place >= 0) & has]
                v[i] = np.where(known[i], _JOIN[kind](v[i], w), w)
                known[i] = True
        _gathered(c, values, how)
        return pa.table({"node": c.node, **{n: pa.array(v, mask=~k) for n, (v, k) in zip(names, values)}})

    found = cut(_tasks(chunked, entries(rows), first, shape))
    if found.where("kind = 2").take(1):
        return None
    links = found.where("kind = 1").select("node", "to")
    given = found.where("kind = 0").groupBy("node").agg(*({"sum": F.sum, "min": F.min, "max": F.max}[k](n).alias(n) for n, k in kinds.items()))
    come = rest(links, given)
    if come is None:
        return None
    return _tasks(chunked, come.select("node", *names, of("node").alias("chunk")), second, f"node long, {fields}")


def rings(links: DataFrame) -> DataFrame:
    """links: node, to. node, next, low: of entries, the next entry on the way and the smallest node before it; and of ways that go
    round within a chunk the smallest node, twice (node and next)."""

    def work(c: _Chunk, entered: pa.Table) -> pa.Table:
        at, low = np.where(c.up < 0, np.arange(c.n), c.up), np.where(c.up < 0, c.node, np.minimum(c.node, c.node[c.up]))
        for _ in range(c.n.bit_length() + 1):
            low, at = np.minimum(low, low[at]), at[at]
        on = np.unique(at[c.up[at] >= 0])  # what never ends is on a way that goes round by now
        sinks = np.unique(low[on])
        here = c.at(entered["node"].to_numpy()) if len(entered) else np.empty(0, "int64")
        here = here[here >= 0]
        here = here[c.leaves[at[here]]]
        return pa.table({"node": np.concatenate([c.node[here], sinks]), "next": np.concatenate([c.out[at[here]], sinks]), "low": np.concatenate([low[here], sinks])})

    return _tasks(links.select("node", "to", of("node").alias("chunk")), entries(links), work, "node long, next long, low long")
