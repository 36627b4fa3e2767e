"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of the vectors, thinned so that no two are near each other, gives the pivots. A vector is described by its
NEAREST pivots in order of nearness; an inverted list for each pivot holds the vectors that name it. Two vectors are
compared where they share at least SHARED pivots: a list is read by the second pivot that its vectors share, so that no
vector meets one that shares the list's pivot alone. A list too long for one task is dealt out by that second pivot, and
what is then still too long is cut into blocks, each pair of blocks a task. A pair that meets more than once counts at the
two smallest pivots that it shares, and by its cosine in double precision. A task sends one row a vector, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean, lean_groups, running, tune

#: Pivots: so many times the square root of the number of vectors, and as many as fit into so many bytes: all tasks hold them.
PIVOT_FACTOR, LEAST_PIVOTS, PIVOT_BYTES = 3.0, 16, 16 << 20
#: Nearest pivots of a vector, pivots that a compared pair shares, vectors of one block.
NEAREST, SHARED, BLOCK = 8, 2, 4000
#: Rows of a segment from which all its cosines are made at once, and pairs of shorter ones that are looked at together.
LONG, PAIRS = 128, 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """(id, v) for each row; v holds the components (`kind`: numpy's type) of a vector that may link, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            out = []
            for v in b.column(1).to_pylist():
                x = np.array(v, kind) + 0.0 if v and None not in v else np.zeros(1)
                out.append(x.astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "v"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding")).mapInArrow(run, "id long, v binary")


def _pivots(classes: DataFrame, n: int, kind: str, cosine: float) -> dict[int, np.ndarray]:
    """Pivots by number of bytes of a vector: chosen by a hash, each far from those before it."""
    longest = classes.agg(F.max(F.length("v"))).first()[0] or 1
    want = int(min(PIVOT_BYTES / (longest * 8 / np.dtype(kind).itemsize), max(LEAST_PIVOTS, PIVOT_FACTOR * n**0.5)))
    want = max(want, 2)
    # Bounded: twice the pivots that are wanted.
    got = classes.orderBy(F.xxhash64("v", F.lit("pivot")), "c").limit(2 * want).select("v").collect()
    kept: dict[int, np.ndarray] = {}
    for size in sorted({len(r.v) for r in got}):
        x = _unit(np.array([np.frombuffer(r.v, kind) for r in got if len(r.v) == size]))
        own, m = np.empty((min(want, len(x)), x.shape[1])), 0
        for v in x:
            if m < len(own) and (not m or (own[:m] @ v).max() < cosine):
                own[m] = v
                m += 1
        kept[size] = own[:m].copy()
    return kept


def _described(classes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """classes (c, copies, v) with len and near: the numbers of the nearest pivots, nearest first.

    near is [-1] for a length of which the sample has fewer than two pivots: one list holds all its vectors.
    """
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, classes.count(), kind, cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            v = b.column("v").to_pylist()
            near: list[list[int]] = [[-1]] * len(v)
            for size in {len(x) for x in v}:
                p = pivots.value.get(size, ())
                if len(p) < SHARED:
                    continue
                at = [i for i, x in enumerate(v) if len(x) == size]
                k = min(NEAREST, len(p))
                for lo in range(0, len(at), 256):
                    own = at[lo : lo + 256]
                    s = _unit(np.frombuffer(b"".join([v[i] for i in own]), kind).reshape(len(own), -1)) @ p.T
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                    for i, x in zip(own, order.tolist(), strict=True):
                        near[i] = x
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(x) for x in v], pa.int32()), pa.array(near, pa.list_(pa.int32()))],
                [*b.schema.names, "len", "near"]
            )

    return classes.select("c", "copies", "v").mapInArrow(run, "c long, copies long, v binary, len int, near array<int>")


def _placed(indexed: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, len, i, j, own, x, y): the tasks that a vector is compared in. i is the pivot of a list, j a second one or -1 for all."""
    lists = indexed.select("c", "len", "near", F.explode("near").alias("i"))
    sizes = scratch.save(lists.groupBy("len", "i").agg(F.count("*").alias("m")).where("m > 1"), NEAREST * indexed.count())
    lists = lists.join(sizes, ["len", "i"])
    whole = (F.col("m") <= BLOCK) | (F.col("i") < 0)
    whole_lists = lists.where(whole).select("c", "len", "i", F.lit(-1).alias("j"))
    parts = lists.where(~whole).select("c", "len", "i", F.explode(F.filter("near", lambda p: p > F.col("i"))).alias("j"))
    rows = scratch.save(whole_lists.unionAll(parts))
    blocks = scratch.save(
        rows.groupBy("len", "i", "j").agg(F.count("*").alias("m")).where("m > 1").select("len", "i", "j", F.ceil(F.col("m") / BLOCK).cast("int").alias("n"))
    )
    own = rows.join(blocks, ["len", "i", "j"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("n")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return own.select("c", "len", "i", "j", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _segments(near: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, second pivots, starts): rows that share i and a second pivot above it, one segment for each; for j = -1 all of
    these, else the rows as one. For i = -1 all rows are one segment."""
    if i < 0 or j >= 0:
        return np.arange(len(near)), np.full(len(near), j), np.array([0, len(near)])
    row, col = np.nonzero(near > i)
    second = near[row, col]
    order = np.argsort(second, kind="stable")
    row, second = row[order], second[order]
    return row, second, np.concatenate([[0], np.flatnonzero(np.diff(second)) + 1, [len(row)]])


def _candidates(near: np.ndarray, i: int, j: int, v: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, second): pairs of rows a < b of one segment with its second pivot, PAIRS at a time; those of long segments only
    where their cosine is enough."""
    rows, second, starts = _segments(near, i, j)
    sizes = np.diff(starts)
    for s in np.flatnonzero(sizes > LONG):
        own = rows[starts[s] : starts[s + 1]]
        for lo in range(0, len(own), 256):
            a, b = np.nonzero(v[own[lo : lo + 256]] @ v[own].T >= cosine)
            ok = a + lo < b
            yield own[a[ok] + lo], own[b[ok]], np.full(int(ok.sum()), second[starts[s]])
    short = np.repeat((sizes > 1) & (sizes <= LONG), sizes)
    rows, second = rows[short], second[short]
    ends = np.repeat(np.cumsum(sizes[(sizes > 1) & (sizes <= LONG)]), sizes[(sizes > 1) & (sizes <= LONG)])
    after = ends - 1 - np.arange(len(rows))
    at = np.cumsum(after)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = after[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        yield rows[a], rows[b], second[a]
        lo = hi


def _compared(placed: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(c, links, low): how many vectors, copies counted, a vector links with in a task, and the smallest that it reaches."""
    none = np.iinfo(np.int64).max

    def run(key, t):
        i, j, x, y = (k.as_py() for k in key[1:])
        t = t.sort_by("c")
        ids, copies, own = (t.column(c).to_numpy() for c in ("c", "copies", "own"))
        v = _unit(np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(len(ids), -1))
        near = np.sort(t.column("near").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64), axis=1)
        low, links = ids.copy(), np.zeros(len(ids), np.int64)
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, second in _candidates(near, i, j, v, cosine):
            ok = (own[a] != own[b]) | (x == y)
            if i >= 0:  # a pair counts once: where the two smallest pivots that it shares meet
                shared = np.sort(np.where((near[a][:, :, None] == near[b][:, None, :]).any(2), near[a], none), axis=1)
                ok &= (shared[:, 0] == i) & (shared[:, 1] == second)
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", v[a], v[b]) >= cosine
            one.append(a[ok]), two.append(b[ok])
        a, b = np.concatenate(one), np.concatenate(two)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):
            before = low.copy()
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
            if (before == low).all():
                break
        some = links > 0
        return pa.table({"c": ids[some], "links": links[some], "low": low[some]})

    return placed.groupBy("len", "i", "j", "x", "y").applyInArrow(lean_groups(run), "c long, links long, low long")


def near_duplicates(rows: DataFrame, *, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `rows` (vec_id, embedding).

    Linked are vectors of one length whose cosine is at least `cosine` and that the index finds. A null, empty or zero
    vector and one with a null or non-finite component link with nothing. Equal vectors are one class and link with each
    other. Rows are vectors of their own: rows that repeat an id with other vectors have links of their own, and a null id
    is linked like any other and is the largest. component_id is the smallest id that links reach. Columns other than the
    two are not looked at. An empty table gives none.
    """
    spark = rows.sparkSession
    tune(spark)
    scratch = Scratch(spark, "pivots")
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = rows.select("vec_id", F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>"))
    base = scratch.save(_vectors(rows, kind).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit("second"), "v")))
    # One row for each vector (by 128 bits), numbered by its smallest id.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("rep")
    classes = base.where("v is not null").groupBy("k1", "k2").agg(rep, F.count("*").alias("copies"), F.first("v").alias("v"))
    n = base.count()
    classes = scratch.save(running(classes, [F.col("rep"), F.col("k1"), F.col("k2")], [], scratch)[0].withColumnRenamed("nth", "c"))
    indexed = scratch.save(_described(classes, kind, cosine))
    placed = _placed(indexed, scratch).join(indexed.select("c", "copies", "v", "near"), "c")
    met = scratch.save(_compared(placed, kind, cosine))
    found = met.groupBy("c").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("c").alias("a"), F.col("low").alias("b")), scratch, met.count())
    names = classes.select("k1", "k2", "c", "copies").join(found, "c", "left").join(comp.withColumnRenamed("v", "c"), "c", "left")
    names = names.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "c").alias("c"))
    names = scratch.save(names.join(classes.select("c", F.col("rep.id").alias("least")), "c").drop("c"), n)
    base = scratch.save(base.select("id", "k1", "k2", F.col("v").isNotNull().alias("valid")), n)
    scratch.drop_but(base, names)
    out = base.join(names, ["k1", "k2"], "left")
    out = out.select(
        F.col("id").alias("vec_id"), F.when(F.col("valid"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("valid"), F.col("least")).otherwise(F.col("id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
