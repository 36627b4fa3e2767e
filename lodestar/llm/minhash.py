"""MinHash near-duplicates with circulant signatures.

Two permutations of D positions make a whole signature: a shingle's hash falls on a position (the first permutation), and
coordinate k is the least value of the second permutation, shifted round by k, over a document's positions. Bands of
coordinates are bucket keys; a pair that shares a bucket is confirmed on its full shingle sets with exact integers.

Documents with equal sets are one class, of which one goes on. In a bucket every class is first compared by signature with
the smallest class of it; those that are not alike to that one, by a wide margin below the threshold, are compared with the
whole bucket, in blocks of bounded size. What is alike joins a cluster. Each cluster's best connected class leads it; what
its exact comparison with the leader links needs no other comparison, and the rest is compared with the whole cluster, again
in pairs of blocks, each a task that counts shared shingles for all its pairs at once and sends one row a class. So no link
is lost but to the signatures (about one in a million at the threshold), a group of copies costs about one comparison a
member in each step, and no table of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean, lean_groups, running, same, tune

POSITIONS = 1 << 20
#: Coordinates of one band; bands for a threshold are chosen so that a pair at it is missed less often than MISS.
BAND = 5
MISS = 1e-6
#: Standard deviations below the threshold at which signatures still count as alike.
DEVIATIONS = 5.5
#: Classes and (in expectation) shingles of one block, and shingles counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 4096
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def n_bands(share: float) -> int:
    return int(np.ceil(np.log(MISS) / np.log1p(-(share**BAND)))) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k words in a row; A-Z in lower case. Fewer words are one shingle, none none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([*map(xxhash.xxh64_intdigest, words)], np.uint64)
    k = min(k, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix(x + h[i : len(h) - k + 1 + i])
    return np.unique(x)


@cache
def _table(k: int, seed: int = 5) -> np.ndarray:
    """The second permutation, continued by its first k values so that a shift by up to k is one window of it."""
    p = np.random.default_rng(seed).permutation(POSITIONS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:k]]), k)


def signature(s: np.ndarray, k: int) -> np.ndarray:
    at = (s >> np.uint64(44)).astype(np.int64)  # the hash is the first permutation: 20 of its bits name a position
    out = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(out, _table(k)[at[i : i + 4096]].min(0), out=out)
    return out


def _sketches(texts: DataFrame, k: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            n, h1, h2, keys, sig = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                if not len(s):
                    h1.append(None), h2.append(None), keys.append(None), sig.append(None)
                    continue
                d = xxhash.xxh128_intdigest(s.tobytes())
                h1.append((d >> 64) - (1 << 63)), h2.append((d & (1 << 64) - 1) - (1 << 63))
                g = signature(s, bands * BAND).reshape(bands, BAND)
                sig.append(g.astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(g)])
            cols = [
                b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "n", "h1", "h2", "keys", "sig"])

    return texts.mapInArrow(run, "id long, h long, n long, h1 long, h2 long, keys array<long>, sig binary")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(c, s) of (c, text): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, k).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["c", "s"])

    return texts.mapInArrow(run, "c long, s binary")


def _blocks(rows: DataFrame, n: int, group: str, scratch: Scratch) -> DataFrame:
    """The n rows with own, x, y: groups cut into blocks of bounded size, each pair of blocks (x <= y) a task.

    rows has c, w (shingles, or 0) and free (boolean): blocks without a free row are not paired with each other or with themselves.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") / BLOCK_SHINGLES)).alias("_n")
    sizes = scratch.save(rows.groupBy(group).agg(blocks, F.count("*").alias("_m"), F.count_if("free").alias("_f")).where("_m > 1 and _f > 0"), n)
    block = F.struct(F.col("free"), F.pmod(F.xxhash64("c"), F.col("_n")).alias("i"))
    own = rows.join(sizes, group).withColumn("own", block)
    other = lambda free: F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.struct(F.lit(free).alias("free"), i.alias("i")))
    free, bound = other(True), F.when(F.col("_f") < F.col("_m"), other(False)).otherwise(F.array())
    own = own.withColumn("_o", F.explode(F.when(F.col("free"), F.concat(free, bound)).otherwise(free)))
    return own.withColumn("x", F.least("own", "_o")).withColumn("y", F.greatest("own", "_o")).drop("_o", "_m", "_n", "_f")


def _lowest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n rows reaches over the links (i, j)."""
    low = ids.copy()
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (before == low).all():
            break
    return low


def _least_alike(share: int, coordinates: int) -> float:
    """Equal coordinates from which signatures count as alike: far enough below the threshold to miss nothing (DEVIATIONS)."""
    s = share / 100
    return max(0.0, s - DEVIATIONS * (s * (1 - s) / coordinates) ** 0.5) * coordinates


def _alike_pairs(pairs: DataFrame, signed: DataFrame, share: int, coordinates: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are alike."""
    least = _least_alike(share, coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(n), -1) for c in ("sa", "sb"))
            ok = ((x == y).sum(1) >= least) & (100 * np.minimum(n, m) >= share * np.maximum(n, m)) if len(n) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(signed.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    both = left.join(signed.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _alike(placed: DataFrame, share: int, coordinates: int) -> DataFrame:
    """(c, low, degree): each class of a pair of blocks that is alike to one and the smallest that it reaches so."""
    least = _least_alike(share, coordinates)

    def run(key, t):
        t = t.sort_by("c")
        ids, n = t.column("c").to_numpy(), t.column("n").to_numpy()
        own = np.array([f"{o['free']}{o['i']}" for o in t.column("own").to_pylist()])
        one = key[1].as_py() == key[2].as_py()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        pairs = []
        for a in range(0, len(ids), 64):
            equal = (sig[a : a + 64, None, :] == sig[None, :, :]).sum(2)
            i, j = np.nonzero(equal >= least)
            i = i + a
            ok = (i < j) & (one | (own[i] != own[j])) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]))
            pairs.append((i[ok], j[ok]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        degree = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        some = degree > 0
        return pa.table({"c": ids[some], "low": _lowest(len(ids), i, j, ids)[some], "degree": degree[some]})

    return placed.groupBy("key", "x", "y").applyInArrow(lean_groups(run), "c long, low long, degree long")


def _linked(placed: DataFrame, share: int) -> DataFrame:
    """(a, b): each class of a pair of blocks and the smallest that links reach, on full sets with exact counts."""

    def run(key, t):
        t = t.sort_by("c")
        ids = t.column("c").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        common = np.zeros((len(ids), len(ids)), np.float32)  # counts stay exact far below 2 ** 24 in each step
        total = np.zeros((len(ids), len(ids)), np.int64)
        for a in range(0, int(at[-1]) + 1, COLUMNS):
            lo, hi = np.searchsorted(at, (a, a + COLUMNS))
            m = np.zeros((len(ids), COLUMNS), np.float32)
            m[row[lo:hi], at[lo:hi] - a] = 1
            np.matmul(m, m.T, out=common)
            total += common.astype(np.int64)
        i, j = np.nonzero(100 * total >= share * (sizes[:, None] + sizes[None, :] - total))
        i, j = i[i < j], j[i < j]
        low = _lowest(len(ids), i, j, ids)
        some = low != ids
        return pa.table({"a": ids[some], "b": low[some]})

    return placed.select("cluster", "c", "s", "x", "y").groupBy("cluster", "x", "y").applyInArrow(lean_groups(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= share * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * i >= share * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, first), one row for each row of docs.

    Documents are linked when the Jaccard similarity of their k-word shingle sets is at least share/100. A null or blank
    text has no shingles and links with nothing; a text of fewer than k words is one shingle. component_id is the smallest
    id that links reach, kept whether that is its own. Rows are documents by their id and text: rows that repeat an id with
    other texts have links of their own, and a null id is linked like any other and is the largest. `first` marks the rows
    of one document of each component, by id and xxhash64 of the text (text_hash). An empty table gives none.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "minhash")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    bands = n_bands(share / 100)
    coordinates = bands * BAND
    sketches = scratch.save(_sketches(texts, k, bands))
    # One row for each set, numbered by its smallest document, so that the smallest number of a component is that of its smallest id.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep")
    sets = sketches.where("h1 is not null").groupBy("h1", "h2", "n").agg(rep, F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes, total = running(sets, [F.col("rep"), F.col("h1"), F.col("h2")], [], scratch)
    classes = scratch.save(classes.withColumnRenamed("nth", "c"))
    n = total["nth"]

    narrow = classes.select(F.explode("keys").alias("key"), "c")
    buckets = scratch.save(narrow.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("lead")).where("m > 1"), bands * n // 2)
    members = scratch.save(narrow.join(buckets, "key"), bands * n)
    met = members.count()
    signed = classes.select("c", "n", "sig")
    led = members.where("c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b")).distinct()
    alike = scratch.save(_alike_pairs(scratch.save(led, met), signed, share, coordinates))
    # What is not alike to the smallest class of a bucket is compared with all of it.
    known = alike.select(F.col("a").alias("c"), F.col("b").alias("lead"), F.lit(True).alias("known"))
    rest = members.where("m > 2").join(known, ["c", "lead"], "left").select(
        "key", "c", F.lit(0).alias("w"), (F.col("known").isNull() & (F.col("c") != F.col("lead"))).alias("free")
    )
    placed = _blocks(scratch.save(rest, met), met, "key", scratch).join(signed, "c")
    more = scratch.save(_alike(placed, share, coordinates))
    cluster = components(alike.unionAll(more.select(F.col("c").alias("a"), F.col("low").alias("b"))), scratch, 2 * met)
    one = F.lit(1).cast("long").alias("degree")
    degree = more.select("c", "degree").unionAll(
        alike.select(F.col("a").alias("c"), one)
    ).unionAll(alike.select(F.col("b").alias("c"), one)).groupBy("c").agg(F.sum("degree").alias("degree"))
    clustered = scratch.save(
        cluster.withColumnsRenamed({"v": "c", "component": "cluster"}).join(degree, "c").join(classes.select("c", F.col("n").alias("w"), "rep"), "c"),
        n
    )
    leader = scratch.save(clustered.groupBy("cluster").agg(F.max_by("c", F.struct("degree", -F.col("c"))).alias("leader")), n)
    of = clustered.select("c", F.col("rep.id").alias("_i"), F.col("rep.h").alias("_h")).hint("shuffle_hash")
    sets = texts.join(of, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select("c", "text")
    sets = scratch.save(_sets(sets, k).dropDuplicates(["c"]) if docs_repeat(sketches) else _sets(sets, k))

    led = scratch.save(clustered.select("c", "cluster", "w").join(leader, "cluster"), n)
    stars = scratch.save(_verified(led.where("c <> leader").select(F.col("c").alias("a"), F.col("leader").alias("b")), sets, share))
    bound = stars.select(F.col("a").alias("c"), F.lit(True).alias("bound"))
    # What no leader binds is compared with its whole cluster; bound classes are not compared with each other.
    rest = led.join(bound, "c", "left").select("c", "cluster", "w", (F.col("bound").isNull() & (F.col("c") != F.col("leader"))).alias("free"))
    others = scratch.save(_linked(_blocks(scratch.save(rest, n), n, "cluster", scratch).join(sets, "c"), share))
    comp = components(stars.unionAll(others), scratch, 2 * n)
    names = classes.select("h1", "h2", "n", "c").join(
        comp.withColumnRenamed("v", "c"), "c", "left"
    ).withColumn("c", F.coalesce("component", "c")).drop("component")
    names = scratch.save(names.join(classes.select("c", "rep"), "c").select("h1", "h2", "n", "rep"), n)
    scratch.drop_but(sketches, names)
    out = sketches.select("id", "h", "n", "h1", "h2").join(names, ["h1", "h2", "n"], "left")
    first = same((F.col("id"), F.col("rep.id")), (F.col("h"), F.col("rep.h"))) & F.col("rep").isNotNull()
    out = out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("component_id"), F.col("h").alias("text_hash"),
        first.alias("first")
    )
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "first")


def docs_repeat(sketches: DataFrame) -> bool:
    """Whether any id stands twice with one text."""
    return bool(sketches.groupBy("id", "h").agg(F.count("*").alias("m")).where("m > 1").limit(1).count())


def one_of_each(docs: DataFrame, *, k: int = 5, share: int = 80) -> DataFrame:
    """docs without near copies: one row of each component of `near_duplicates`, and all rows without words."""
    found = Scratch(docs.sparkSession, "first").save(near_duplicates(docs, k=k, share=share).where("first or n_shingles = 0"))
    stays = found.groupBy("doc_id", "text_hash").agg((F.max("first") & (F.count("*") > 1)).alias("twice"))
    rows, hashed = docs.alias("_docs"), F.xxhash64(F.col("_docs.text").cast("string"))

    def of(those: DataFrame) -> DataFrame:
        # The decisions are narrow and the built side of a hashed join: texts are moved once and never sorted.
        return rows.join(
            those.hint("shuffle_hash").alias("_those"),
            F.col("_docs.doc_id").cast("long").eqNullSafe(F.col("_those.doc_id")) & (hashed == F.col("_those.text_hash")), "left_semi"
        )

    once = of(stays.where("not twice"))
    if not stays.where("twice").limit(1).count():
        return once
    key = next(k for k in (f"_key{i}" for i in range(len(docs.columns) + 1)) if k not in docs.columns)
    return once.unionAll(of(stays.where("twice")).withColumn(key, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", key]).drop(key))
