"""Line dedup: a suffix array of the corpus's lines by distributed prefix doubling; later copies of repeated runs are deleted.

The corpus is one sequence of lines: documents in order of doc_id, in each its non-blank lines. A run is some lines in a row
of one document, compared by their words.

1. Line ids. Lines that stand twice get their rank among all lines by 128-bit hash, as ranks of runs of one line.
2. Prefix doubling. Runs of 2^(k+1) lines that start at a place have the pair (rank, rank 2^k lines on) as key; keys that
   stand twice are sorted and get their ranks. A place whose run stands once leaves: its class is settled. So each round
   holds only places of repeated runs, and the ranks order them as the suffix array does.
3. Intervals of common prefixes. For each place the longest run that also starts at an earlier place is found by descent
   over the ranks: a class of places that share so many lines is an interval of the suffix array, and falls apart into the
   intervals of those that share 2^j lines more. In each the first place stands for all where it is compared outside.
4. A run of that length that does not lie in the one a line before is a maximal repeated run; its lines are deleted, as its
   first copy stays where it is.

All rounds are joins and sums over places, saved to the shared folder; a place goes on in one class of a descent and stands
for others in at most as many again, so that no round holds more than twice the places of repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import Scratch, lean, running, tune

#: Repeated runs count from so many words: all of them, a lone line of one word too.
MIN_WORDS = 1
ADDED = ("n_lines", "n_deleted", "n_runs", "longest_run")


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


def line_ids(keyed: DataFrame) -> DataFrame:
    """(id, h, s, n1, n2) of (id, h, text): each non-blank line's number in its document and the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            ids, hs, at, n1, n2 = [], [], [], [], []
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                solid = [w for x in lines_of(t) if (w := x.split())]
                ids += [i] * len(solid)
                hs += [h] * len(solid)
                at += range(len(solid))
                for w in solid:
                    d = xxhash.xxh128_intdigest(" ".join(w).encode("utf-8", "surrogatepass"))
                    n1.append((d >> 64) - (1 << 63)), n2.append((d & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hs, at, n1, n2)], ["id", "h", "s", "n1", "n2"])

    return keyed.mapInArrow(run, "id long, h long, s long, n1 long, n2 long")


def ranked(places: DataFrame, key: list[str], n: int, scratch: Scratch) -> tuple[DataFrame | None, int]:
    """(pos, left, rank, first) of the places (pos, left, key; n of them) of classes with several places, and their number."""
    classes = places.groupBy(*key).agg(F.count("*").alias("m"), F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").drop("last")
    order, total = running(classes, [F.col(c) for c in key], ["m"], scratch, n // 2)
    if not total["nth"]:
        return None, 0
    order = order.select(*key, F.col("before_m").alias("new"), "first")
    return scratch.save(places.join(order, key).select("pos", "left", F.col("new").alias("rank"), "first"), total["m"]), total["m"]


def doubled(places: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """Levels k of (pos, left, rank, first): places whose run of 2^k lines stands twice, its rank and its first place.

    places is (pos, left, line), n rows: a line's place in the corpus, the lines from it to its document's end, and its id.
    """
    levels, key = [], ["line"]
    while True:
        level, n = ranked(places, key, n, scratch)
        if level is None:
            return levels
        levels.append(level)
        far = 1 << (len(levels) - 1)
        on = level.select((F.col("pos") - far).alias("pos"), F.col("rank").alias("next"))
        places, key = scratch.save(level.where(F.col("left") > far).join(on, "pos").select("pos", "left", "rank", "next"), n), ["rank", "next"]


def longest(levels: list[DataFrame], n: int, scratch: Scratch) -> DataFrame:
    """(pos, len): the most lines from a place that also stand in a row from an earlier place; places with none are left out.

    An interval is (first, len): the places that share so many lines with the first of them, which is no match for itself
    there. One step tells those apart that share 2^j more; the first of such an interval stands in both. n is the number of
    places of the lowest level.
    """
    found = None
    for j in range(len(levels) - 1, -2, -1):
        # Places that are later copies at 2^(j+1) lines and not at twice as many, with the first of their interval.
        if j + 1 < len(levels):
            level = levels[j + 1]
            new = level.where("pos > first")
            if j + 2 < len(levels):
                new = new.join(levels[j + 2].where("pos > first").select("pos"), "pos", "left_anti")
            new = scratch.save(new.select("first", F.lit(2 << j if j >= 0 else 1).cast("long").alias("len"), "pos", "left"), n)
            firsts = new.groupBy("first", "len").agg(F.lit(0)).select("first", "len").join(level.where("pos = first").select("first", "left"), "first")
            new = new.unionByName(firsts.select("first", "len", F.col("first").alias("pos"), "left"))
            found = scratch.save(new if found is None else found.unionByName(new), 2 * n)
        if j < 0 or found is None:
            continue
        far = levels[j].select(F.col("pos").alias("to"), F.col("rank").alias("next"))
        to = F.when(F.col("left") > F.col("len"), F.col("pos") + F.col("len"))
        seen = scratch.save(found.withColumn("to", to).join(far, "to", "left").drop("to"), 2 * n)
        inner = seen.where("next is not null").groupBy("first", "len", "next").agg(
            F.min("pos").alias("head"), F.max("pos").alias("last")
        ).where("head < last").drop("last")
        both = seen.join(scratch.save(inner, n), ["first", "len", "next"], "left")
        here, deeper = F.struct("first", "len"), F.struct(F.col("head").alias("first"), (F.col("len") + (1 << j)).alias("len"))
        goes = F.when(F.col("head").isNull(), F.array(here)).when(F.col("pos") > F.col("head"), F.array(deeper)).otherwise(F.array(here, deeper))
        found = scratch.save(both.select(F.explode(goes).alias("i"), "pos", "left").select("i.first", "i.len", "pos", "left"), 2 * n)
    return found.where("pos > first").select("pos", "len")


def maximal_runs(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, h, s, e): lines s to e - 1 of a document are a later copy and no longer run holds them; None where none repeats.

    docs is (id, h, text). Equal rows are one document.
    """
    named = scratch.save(line_ids(docs))
    often, total = running(
        named.groupBy("n1", "n2").agg(F.count("*").alias("m")).where("m > 1"), [F.col("n1"), F.col("n2")], ["m"], scratch,
        named.count() // 2
    )
    if not total["nth"]:
        return None
    n = total["m"]
    # Both sides of this join are dealt out by the name for it alone, so that Spark may split it where one line is very common.
    often = often.select("n1", "n2", F.col("before_m").alias("line"))
    lines = scratch.save(named.join(often, ["n1", "n2"]).select("id", "h", "s", "line"), n)
    whole = lines.groupBy("id", "h").agg((F.max("s") + 1).alias("n"))
    start, _ = running(whole, [F.col("id").asc_nulls_first(), F.col("h")], ["n"], scratch, n)
    start = start.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "n", F.col("before_n").alias("start"))
    lines = lines.join(start, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select(
        "id", "h", "s", (F.col("start") + F.col("s")).alias("pos"), (F.col("n") - F.col("s")).alias("left"), "line"
    )
    lines = scratch.save(lines.distinct(), n)
    levels = doubled(lines.select("pos", "left", "line"), n, scratch)
    if not levels:
        return None
    runs = scratch.save(longest(levels, n, scratch), n)
    before = runs.select((F.col("pos") + 1).alias("pos"), F.col("len").alias("had"))
    top = runs.join(before, "pos", "left").where("had is null or had <= len").select("pos", "len")
    return scratch.save(top.join(lines, "pos").select("id", "h", "s", (F.col("s") + F.col("len")).alias("e")), n)


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` without the later copies of its repeated runs of at least `min_words` words, and n_lines, n_deleted
    (lines), n_runs (maximal repeated runs deleted) and longest_run (lines of the longest), long, in place of such columns.

    Blank lines stay where they are and break no run; lines are compared by their words, whatever the space between.
    Null and empty texts stay as they are. Rows that repeat a doc_id and its text are one document; rows that repeat an id
    with other texts are told apart by a hash of the text. An empty table gives an empty one.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    rest = [c for c in docs.columns if c not in ADDED]
    key = (F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    runs = maximal_runs(docs.select(key[0].alias("id"), key[1].alias("h"), F.col("text").cast("string").alias("text")), scratch)
    keyed = docs.select(*rest).alias("_docs")
    if runs is None:
        scratch.drop_but()
        joined = keyed.select("_docs.*", F.lit(None).cast("array<struct<s:long,e:long>>").alias("_cut"))
    else:
        # The cuts are narrow and the built side of a hashed join: texts are moved once and never sorted.
        cuts = scratch.save(runs.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("_cut")), runs.count())
        scratch.drop_but(cuts)
        cuts = cuts.hint("shuffle_hash").alias("_cuts")
        joined = keyed.join(
            cuts,
            F.col("_docs.doc_id").cast("long").eqNullSafe(F.col("_cuts.id")) & (F.xxhash64(F.col("_docs.text").cast("string")) == F.col("_cuts.h")),
            "left"
        ).select("_docs.*", "_cuts._cut")
    at = rest.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            texts, added = [], []
            for t, cut in zip(b.column(at).to_pylist(), b.column(len(rest)).to_pylist(), strict=True):
                lines, gone, runs = lines_of(t), set(), []
                if cut:
                    solid = [i for i, x in enumerate(lines) if x.split()]
                    runs = [c for c in cut if min_words <= 1 or sum(len(lines[i].split()) for i in solid[c["s"] : c["e"]]) >= min_words]
                    gone = {solid[j] for c in runs for j in range(c["s"], c["e"])}
                    t = "\n".join([x for i, x in enumerate(lines) if i not in gone])
                texts.append(t)
                added.append((len(lines), len(gone), len(runs), max((c["e"] - c["s"] for c in runs), default=0)))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(rest))]
            new = [*zip(*added, strict=True)] or [()] * len(ADDED)
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c, pa.int64()) for c in new]], [*rest, *ADDED])

    schema = StructType([f for f in docs.schema.fields if f.name in rest])
    for c in ADDED:
        schema = schema.add(c, LongType())
    # By place, as docs may have a column of any name.
    return joined.toDF(*[f"c{i}" for i in range(len(rest) + 1)]).mapInArrow(apply, schema)
