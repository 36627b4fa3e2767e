"""Helpers that the training-data operators share: shared-folder tables, folds, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker's memory is bounded whatever a document's length.
ARROW_ROWS = 2000
ARROW_BYTES = 4 << 20
#: Narrow rows of one file of a small table.
FILE_ROWS = 100_000
#: Bytes that a worker reads between two times that it gives unused memory back to the system.
RELEASE = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (not the results) and see that its executors can import this package.

    The two settings stay, as plans are run after the operators that made them have returned.
    """
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _ship(spark: SparkSession) -> None:
    """Once a context, send the package to the executors, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    sc._lodestar_shipped = True


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give unused memory back to the system: idle workers stay and count against their executor."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory is released after every RELEASE bytes and at the end."""
    read = 0
    for b in batches:
        read += b.nbytes
        yield b
        del b
        if read > RELEASE:
            read = 0
            release()
    release()


def lean_groups(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """`run` for applyInArrow; memory is released after every RELEASE bytes."""
    read = 0

    def released(key, table):
        nonlocal read
        out = run(key, table)
        read += table.nbytes
        if read > RELEASE:
            read = 0
            release()
        return out

    return released


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a temporary one, but on one machine only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to survive lost executors.

    What a result still reads stays in the folder, as results are lazy; an operator drops the rest before it returns.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as written and read again. Where it has at most `rows` narrow rows, in files of at least FILE_ROWS of them: small
        tables in many files cost more in files than in rows, and a process or two for each file on a local disk."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        few = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
        few.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        self.paths.append(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        self._delete(df._scratch_path)
        self.paths.remove(df._scratch_path)

    def drop_but(self, *kept: DataFrame) -> None:
        """Delete all saved tables but these."""
        for path in {*self.paths} - {df._scratch_path for df in kept}:
            self._delete(path)
        self.paths = [df._scratch_path for df in kept]

    def drop_all(self) -> None:
        self._delete(self.base)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def same(*pairs: tuple[Column, Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def running(rows: DataFrame, by: list[Column], sums: list[str], scratch: Scratch, most: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """rows with nth (from 0) and for each of `sums` (never null) its total over the rows before, as before_<name>, in the
    order `by`; and the totals of all, the number of rows as nth. There are at most `most` narrow rows, if that is known.

    Rows are dealt by ranges of `by` and summed within a range; one row a range reaches the driver, so no task holds them all.
    """
    dealt = scratch.save(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), most)
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_nth"), *[F.sum(c).alias(c) for c in sums]).orderBy("_range").collect()
    own = Window.partitionBy("_range").orderBy(*by)
    out = dealt.withColumn("nth", (F.row_number().over(own) - 1).cast("long"))
    for c in sums:
        # By rows, as rows that are equal in `by` stand one after another all the same.
        out = out.withColumn(f"before_{c}", F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c))
    for c, to in [("_nth", "nth"), *[(c, f"before_{c}") for c in sums]]:
        ahead = accumulate((r[c] for r in totals[:-1]), initial=0 * totals[0][c]) if totals else ()
        start = F.create_map(*[F.lit(x) for r, a in zip(totals, ahead, strict=True) for x in (r["_range"], a)]) if totals else None
        out = out.withColumn(to, F.col(to) + start[F.col("_range")]) if totals else out
    return out.drop("_range"), {"nth": sum(r["_nth"] for r in totals)} | {c: sum(r[c] for r in totals) for c in sums}


def components(edges: DataFrame, scratch: Scratch, most: int | None = None, most_rounds: int = 40) -> DataFrame:
    """(v, component) for each vertex of `edges` (a, b: long, undirected; at most `most`); component is its smallest vertex.

    Alternating star contraction: every round sends each neighbour of a vertex to the smallest one. Minima are summed
    map-side and written to the shared folder, as are each round's edges, so that both sides of the join back to the edges
    are plain tables and Spark can split it where a vertex is hot. Rounds grow with the logarithm of the longest path.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), most)
    for _ in range(most_rounds):
        # Settled: every vertex has one way down, and that ends there. One aggregation, summed map-side.
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionAll(
            e.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("root"))
        )
        open_ = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down > 1 or down = 1 and root = 1")
        if not open_.agg(F.count("*")).first()[0]:
            break
        most = 2 * e.count()
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, scratch, most, larger_only=True)
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, most, larger_only=False)
        scratch.drop(e)
        scratch.drop(large)
        e = small
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("v"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())


def _star(uv: DataFrame, scratch: Scratch, most: int, *, larger_only: bool) -> DataFrame:
    """Link each neighbour v of u (and u itself in the small star) to the smallest of u and its neighbours."""
    least = scratch.save(uv.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), most)
    to = uv.join(least, "u")
    if larger_only:
        out = to.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = to.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.save(out.where("a <> b").distinct(), most)
    scratch.drop(least)
    return out
