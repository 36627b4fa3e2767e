"""WARC fixity: Merkle trees over records and ordered offset ranges, compared between replicas.

Pages become WARC resource records, dealt by a hash to files of bounded expected length and ordered by id within each. A
leaf is the hash of a record and its offset range; a node hashes up to FAN children and the range that they span. Roots are
compared first, and only below nodes that differ are children looked at, level by level. The leaves that differ are then
aligned by record, so that one that was lost or put in does not make those damaged that it only moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running, same, tune

FAN = 16
RECORDS_PER_FILE = 1000
#: The date that records bear: `pages` has no time of its crawl.
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, n_files: int, *, date: str = DATE) -> DataFrame:
    """(page_id, file, body): the WARC record of each page. Null urls and bodies count as empty; equal pages give equal records."""
    page_id, url, html = F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), url).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(
            F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")
        ), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(
            F.lit("WARC-Payload-Digest: sha256:"), F.sha2(html.cast("binary"), 256)
        ), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
    ]
    body = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    file = F.pmod(F.crc32(F.concat_ws("\n", page_id.cast("string"), url).cast("binary")), F.lit(n_files)).cast("int")
    return pages.select(page_id.alias("page_id"), file.alias("file"), body.alias("body"))


def leaves(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, level 0, node, hash, lo, hi, page_id, record) in file order: by id (null first), then by the record's hash.

    Records are numbered over all files at once, by ranges, so that a long file does not stand in one task.
    """
    hashed = scratch.save(
        recs.select("page_id", "file", F.sha2(F.col("body").cast("binary"), 256).alias("record"), F.octet_length("body").cast("long").alias("n"))
    )
    n = hashed.count()
    placed = scratch.save(running(hashed, [F.col("file"), F.col("page_id").asc_nulls_first(), F.col("record")], ["n"], scratch, n)[0], n)
    start = placed.groupBy("file").agg(F.min("nth").alias("_first"), F.min("before_n").alias("_at"))
    placed = placed.join(start, "file").withColumn("lo", F.col("before_n") - F.col("_at")).withColumn("hi", F.col("lo") + F.col("n"))
    return placed.select(
        "file", F.lit(0).alias("level"), (F.col("nth") - F.col("_first")).alias("node"), _hash("record", "lo", "hi").alias("hash"), "lo",
        "hi", "page_id", "record"
    )


def _hash(what: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", what, F.col(lo) if isinstance(lo, str) else lo, F.col(hi) if isinstance(hi, str) else hi).cast("binary"), 256)


def above(nodes: DataFrame) -> DataFrame:
    """The next level: a node for every FAN children in order."""
    own = nodes.groupBy("file", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / FAN).alias("node"))
    own = own.agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return own.select("file", "level", "node", _hash(F.array_join(F.transform("c", lambda x: x["hash"]), ""), "lo", "hi").alias("hash"), "lo", "hi")


def tree(base: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels from the leaves to the roots, saved; each is FAN times smaller than the one below."""
    levels = [scratch.save(base)]
    n = levels[0].count()
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(scratch.save(above(levels[-1]), n))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of `primary` and each that only the replica has: page_id, file, offset, length, record_sha256,
    root, root_matches, damaged, moved.

    Both are results of `records`. root_matches compares the roots themselves: the hash and height of the file's tree in both,
    so that a surplus record or file or one that is lost never passes. A record is damaged if the replica has it changed or
    not at all, or has it only itself (then with the replica's offset, length and hash and a null root); it is moved if the
    replica has it whole at another offset. Repeated pages are records of their own. Empty tables give none.
    """
    scratch = Scratch(primary.sparkSession, "merkle")
    tune(primary.sparkSession)
    one, two = tree(leaves(primary, scratch), scratch), tree(leaves(replica, scratch), scratch)
    ends = roots(one).join(roots(two).withColumnsRenamed({"root": "other", "height": "reach"}), "file", "full")
    n = one[0].count() + two[0].count()
    ends = scratch.save(ends.select("file", "root", same((F.col("root"), F.col("other")), (F.col("height"), F.col("reach"))).alias("root_matches")), n)
    off = ends.where("not root_matches").select("file")
    bad = None
    # From the highest level that both trees have, whatever either has above it.
    for level in range(min(len(one), len(two)) - 1, -1, -1):
        mine, theirs = (_open(t[level], off, bad) for t in (one, two))
        both = mine.join(theirs.withColumnRenamed("hash", "theirs"), ["file", "node"], "full")
        bad = scratch.save(both.where(~F.col("hash").eqNullSafe(F.col("theirs"))).select("file", "node"), n)
    # Align what differs: first whole records, then those of one id, each of them with one of the other side.
    mine, theirs = (scratch.save(_numbered(t[0].join(bad, ["file", "node"], "left_semi"), "record"), n) for t in (one, two))
    moved = _paired(mine, theirs, "record")
    mine, theirs = (
        scratch.save(_numbered(a.join(_paired(a, b, "record"), ["file", "node"], "left_anti"), "page_id"), n) for a,
        b in ((mine, theirs), (theirs, mine))
    )
    surplus = theirs.join(_paired(theirs, mine, "page_id"), ["file", "node"], "left_anti")
    marked = mine.select(
        "file", "node", F.lit(True).alias("damaged"), F.lit(False).alias("moved")
    ).unionAll(moved.select("file", "node", F.lit(False), F.lit(True)))
    columns = ["page_id", "file", "lo", "hi", "record", "root", "root_matches", "damaged", "moved"]
    out = one[0].join(ends, "file").join(marked, ["file", "node"], "left").select(*columns)
    out = out.unionAll(
        surplus.join(ends, "file").withColumn(
            "root", F.lit(None).cast("string")
        ).withColumn("damaged", F.lit(True)).withColumn("moved", F.lit(False)).select(*columns)
    )
    no = F.lit(False)
    out = out.select(
        "page_id", "file", F.col("lo").alias("offset"), (F.col("hi") - F.col("lo")).alias("length"), F.col("record").alias("record_sha256"),
        "root", "root_matches", F.coalesce("damaged", no).alias("damaged"), F.coalesce("moved", no).alias("moved")
    )
    out = scratch.save(out, n)
    scratch.drop_but(out)
    return out


def _numbered(leaves: DataFrame, by: str) -> DataFrame:
    """leaves with k: which of its equals (in file, page_id and, by record, in hash) a leaf is."""
    key = ["file", "page_id"] + ["record"] * (by == "record")
    return leaves.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("record", "node")))


def _paired(mine: DataFrame, theirs: DataFrame, by: str) -> DataFrame:
    """(file, node) of those of `mine` that have a partner: the same k of their equals."""
    a, b = mine.alias("a"), theirs.alias("b")
    on = same(*[(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ["file", "page_id", "k"] + ["record"] * (by == "record")])
    return a.join(b, on, "left_semi").select("file", "node")


def roots(levels: list[DataFrame]) -> DataFrame:
    """(file, root, height): the hash at the top of a file's own tree, its first level of one node, whatever other files need."""
    tops = [
        level.groupBy("file").agg(F.count("*").alias("n"), F.first("hash").alias("root")).where("n = 1").select("file", F.lit(i).alias("height"), "root") for i,
        level in enumerate(levels)
    ]
    return reduce(DataFrame.unionAll, tops).groupBy("file").agg(F.min_by("root", "height").alias("root"), F.min("height").alias("height"))


def _open(nodes: DataFrame, off: DataFrame, bad: DataFrame | None) -> DataFrame:
    """(file, node, hash) below the nodes `bad` of the level above; at the top, all of the files `off`."""
    if bad is None:
        return nodes.join(off, "file", "left_semi").select("file", "node", "hash")
    parent = bad.select("file", F.col("node").alias("up"))
    return nodes.withColumn("up", F.floor(F.col("node") / FAN)).join(parent, ["file", "up"], "left_semi").select("file", "node", "hash")
