"""Mixing sources to target weights by cube-method balanced sampling.

Targets are reached by whole copies first: a source whose target is r times its size takes every document floor(r) times,
and the rest of r is the inclusion probability of one more copy. The cube method turns these fractional probabilities into
zeros and ones. In blocks of bounded size it moves three open probabilities at a time along the null space of the two
constraints (documents and words), so both totals keep their expectation exactly; what is still open when a block ends,
two documents at most, goes to the next, much smaller round. The smallest documents of each source are kept for the last
round: whatever is open by then, the landing problem is solved over them, to less than a small document's words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running, same, tune

#: Documents of one block (in expectation) and the open ones that the last round may hold for a source.
BLOCK = 4000
#: The smallest documents of a source (in expectation) that wait for its last round.
SMALL = 1000
MOST_COPIES = 3.0
FEW_SOURCES = 10_000
#: A probability this near to 0 or 1 is settled.
EDGE = 1e-9
#: Parts of one that a hash is compared with.
PARTS = 1 << 30
WORDS = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, scratch: Scratch, rows: int, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target) from `rows` rows (source, size, n documents).

    Sources in code-point order, null last, weigh 1, 2, 3 and so on again and share the total of all sizes by weight; a
    share stops at `most` times its source's size and the excess is shared anew. Sorted by what a source can take for
    each unit of weight, the first k sources stop and the others share what is left: one pass finds k.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("docs"))
    name = F.col("source").asc_nulls_last()
    ranked = running(by_source, [name], [], scratch, rows)[0].withColumn("weight", F.col("nth") % 3 + 1).drop("nth")
    ranked = ranked.withColumn("room", F.lit(most) * F.col("source_size")).withColumn("per_weight", F.col("room") / F.col("weight"))
    ranked = scratch.save(running(ranked, [F.col("per_weight"), F.col("weight"), name], ["room", "weight"], scratch, rows)[0], rows)
    size, weight = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight").cast("double")).first()
    # What is left for this source and those after it, shared by their weights.
    level = (F.lit(size) - F.col("before_room")) / (F.lit(weight) - F.col("before_weight"))
    top = ranked.agg(F.max(F.when(level <= F.col("per_weight"), level))).first()[0]
    share = F.least(F.col("room"), F.col("weight") * F.lit(top)) if top is not None else F.col("room")
    return ranked.select("source", "source_size", "docs", share.alias("target"))


def cube(n: np.ndarray, size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 and keep sum(p * n) and sum(p * size); at most two stay open. Earlier rows settle first."""
    p = p.copy()
    held: list[int] = []
    draws = rng.random(len(p))
    for new in range(len(p)):
        if not EDGE < p[new] < 1 - EDGE:
            p[new] = round(p[new])
            continue
        held.append(new)
        if len(held) < 3:
            continue
        # The null space of the rows n and size over the three held documents: their cross product.
        a, b, c = held
        v = [n[b] * size[c] - n[c] * size[b], n[c] * size[a] - n[a] * size[c], n[a] * size[b] - n[b] * size[a]]
        if not any(v):
            v = [n[b], -n[a], 0.0]
        move = [(i, x) for i, x in zip(held, v, strict=True) if x]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in move)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in move)
        step = up if draws[new] < down / (up + down) else -down
        for i, x in move:
            p[i] += step * x
        for i in held:
            if not EDGE < p[i] < 1 - EDGE:
                p[i] = round(p[i])
        held = [i for i in held if EDGE < p[i] < 1 - EDGE]
    return p


def land(size: np.ndarray, p: np.ndarray, whole: np.ndarray, want: float, most: float) -> np.ndarray:
    """Settle the last open documents, then move copies by one to bring the words near to `want`.

    want is what sum(p * size) shall be. whole + p stays within 0 and `most`. Larger documents move first, then the one or two
    whose move helps most, until none helps: what remains is less than the smallest document, where there are a few dozen.
    """
    p = np.where((p > EDGE) & (p < 1 - EDGE), 0.0, np.round(p))
    left = want - float(p @ size)
    for i in np.argsort(-size, kind="stable"):
        step = 1 if left > 0 else -1
        if 0 < size[i] <= abs(left) and 0 <= whole[i] + p[i] + step <= most:
            p[i] += step
            left -= step * size[i]
    while True:
        moves = [(np.flatnonzero((size > 0) & (whole + p + step >= 0) & (whole + p + step <= most)), step) for step in (1, -1)]
        at, step = np.concatenate([m for m, _ in moves]), np.concatenate([np.full(len(m), s) for m, s in moves])
        order = np.argsort(step * size[at], kind="stable")
        at, step = at[order], step[order]
        by = step * size[at]
        # One move, or one and the nearest other to what it leaves.
        found = [(abs(left - by[k]), k, -1) for k in np.argsort(np.abs(left - by), kind="stable")[:1]]
        near = np.searchsorted(by, left - by)
        for shift in (-2, -1, 0, 1):
            other = near + shift
            ok = (other >= 0) & (other < len(by))
            ok[ok] = at[other[ok]] != at[ok]
            if ok.any():
                off = np.where(ok, np.abs(left - by - by[np.where(ok, other, 0)]), np.inf)
                k = int(np.argmin(off))
                found.append((off[k], k, int(other[k])))
        if not found or (best := min(found))[0] > abs(left) - 1e-6:
            return p
        for k in best[1:]:
            if k >= 0:
                p[at[k]] += step[k]
                left -= by[k]


def _seed(*key: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big")


def _flight(units: DataFrame, seed: int, level: int, most: float | None = None) -> DataFrame:
    """One round: the cube in each block, and the landing where it is the last (`most` is given)."""

    def run(key, t):
        t = t.sort_by([("size", "descending"), ("tie", "ascending")])
        n, s, p, whole = (t.column(c).to_numpy().astype(float) for c in ("n", "size", "p", "whole"))
        want = float(p @ (n * s))
        p = cube(n, n * s, p, np.random.default_rng(_seed(seed, level, key[0].as_py(), key[1].as_py())))
        return t.set_column(t.column_names.index("p"), "p", pa.array(p if most is None else land(n * s, p, whole, want, most)))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def decide(docs: DataFrame, *, seed: int = 11, most: float = MOST_COPIES) -> DataFrame:
    """(doc_id, source, text_hash, size, n, source_size, target, copies): how often the mix takes a document.

    Rows alike in doc_id, source and text (by a 64-bit hash) are one unit of n rows: the mix takes all of them equally
    often. A source without words has target 0 and none of its documents is taken. An empty table gives an empty one.
    Equal tables give equal mixes, however they are partitioned: blocks, order and draws come from hashes of the rows.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size_of(F.col("text").cast("string")).alias("size"))
    units = narrow.groupBy("doc_id", "source", "text_hash").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    units = scratch.save(units.withColumn("tie", F.xxhash64("doc_id", "source", "text_hash", F.lit(seed))))
    n_units = units.count()
    totals = scratch.save(targets(units.select("source", (F.col("size") * F.col("n")).alias("size"), "n"), scratch, n_units, most), n_units)
    # One row a source: joined by broadcast where they are few, by a shuffle that Spark may split where not.
    few = totals.count() <= FEW_SOURCES
    with_source = lambda rows, one: rows.join(F.broadcast(one) if few else one, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    r = with_source(units, totals.select(F.col("source").alias("of"), "source_size", "target", "docs", ratio.alias("r")))
    r = r.withColumn("whole", F.floor(F.col("r") + EDGE).cast("int")).withColumn("p", F.greatest(F.col("r") - F.col("whole"), F.lit(0.0)))
    is_open = F.col("p").between(EDGE, 1 - EDGE)
    columns = ["doc_id", "source", "text_hash", "size", "n", "tie", "whole", "p"]
    settled = [r.where(~is_open).select(*columns)]

    # For each source the size up to which all documents wait for its last round, and the share of the next size that does.
    by_size = r.where(is_open & (F.col("size") > 0)).groupBy("source", "size").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source").orderBy("size"))
    by_size = by_size.withColumn("upto", upto).where(F.col("upto") - F.col("m") < SMALL)
    edge = by_size.groupBy(F.col("source").alias("of")).agg(
        F.max("size").alias("edge"), F.max_by((F.lit(SMALL) - F.col("upto") + F.col("m")) / F.col("m"), "size").alias("part")
    )
    waits = (F.col("size") > 0) & ((F.col("size") < F.col("edge")) | (F.col("size") == F.col("edge")) & (F.pmod("tie", F.lit(PARTS)) < F.col("part") * PARTS))
    marked = r.where(is_open).join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("of")), "left")
    marked = scratch.save(marked.select(*columns, F.coalesce(waits, F.lit(False)).alias("waits")), n_units)
    small, now = marked.where("waits").drop("waits"), marked.where("not waits").drop("waits")
    level = 0
    while True:
        n_open = scratch.save(now.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("of_source")), n_units)
        if (n_open.agg(F.max("of_source")).first()[0] or 0) <= BLOCK:
            break
        block = F.pmod(F.xxhash64("tie", F.lit(level)), F.ceil(F.col("of_source") / BLOCK)).cast("int")
        now = scratch.save(_flight(with_source(now, n_open).select(*columns, block.alias("block")), seed, level).drop("block"))
        settled.append(now.where(~is_open))
        now = now.where(is_open)
        level += 1
    settled.append(scratch.save(_flight(now.unionAll(small).withColumn("block", F.lit(0)), seed, level, most).drop("block")))
    taken = settled[0]
    for s in settled[1:]:
        taken = taken.unionAll(s)
    taken = with_source(taken, totals.select(F.col("source").alias("of"), "source_size", "target"))
    copies = (F.col("whole") + F.round("p").cast("int")).alias("copies")
    out = scratch.save(
        taken.select("doc_id", "source", "text_hash", "size", "n", "source_size", F.col("target").cast("double").alias("target"), copies),
        n_units
    )
    scratch.drop_but(out)
    return out


def mix(docs: DataFrame, *, seed: int = 11, most: float = MOST_COPIES) -> DataFrame:
    """docs with size, source_size, target and copies (int, how often the mix takes the document) in place of such columns.

    Null, empty and very long texts, repeated rows and empty tables: as in `decide`. Decisions are narrow and are the built
    side of a hashed join, so whole texts are moved once and never sorted.
    """
    taken = decide(docs, seed=seed, most=most).drop("n")
    rest = docs.select(*[c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]).alias("_docs")
    on = same(*[(F.col(f"_docs.{c}"), F.col(f"_taken.{c}")) for c in ("doc_id", "source")]) & (F.xxhash64("_docs.text") == F.col("_taken.text_hash"))
    return rest.join(taken.hint("shuffle_hash").alias("_taken"), on).select("_docs.*", *[f"_taken.{c}" for c in ("size", "source_size", "target", "copies")])


def repeat(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as `copies` says."""
    return mixed.where("copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_")
