"""The pipeline's stages against brute-force versions, each on its own input, and on tables of edge cases."""

import hashlib
import itertools
import re
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import embed_dedup, linedup, media, minhash, mixing, quality, secrets, toxicity, warc

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
STAGE = dict(pipeline.STAGES)
EXTRA = ["kept", "score", "size", "copies", "held_out", "predicted", "_cut", "_h", "n_deleted", "text_hash", "first", "target", "_key", "_docs"]


def text_of(r):
    return r.text or ""


def test_stages():
    assert [k for k, _ in pipeline.STAGES] == ["quality", "line_dedup", "minhash", "mixing", "bpe"] and pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Input and output of each stage on the small tables."""
    at, docs, out = tmp_path_factory.mktemp("run"), spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(at / name))
        result = spark.read.parquet(str(at / name))
        if name != "bpe":
            assert result.dtypes == docs.dtypes
        out[name] = (docs.collect(), result.collect())
        docs = result
    return out


def test_quality(spark, runs):
    before, after = runs["quality"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True))
    scores = model.score([r.text for r in before])
    assert sorted(after) == sorted(r for r, s in zip(before, scores, strict=True) if s >= 0.3)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [i for i, y in label.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and len(after) < len(before)


def test_line_dedup(runs):
    before, after = runs["line_dedup"]
    seen, want = set(), []
    for r in sorted(before, key=lambda r: r.doc_id):
        out, gone = [], 0
        for line in text_of(r).split("\n"):
            words = tuple(line.split())
            gone += bool(words) and words in seen
            if not words or words not in seen:
                out.append(line)
            if words:
                seen.add(words)
        if not gone or "".join(out).strip(" \t\n\x0b\x0c\r"):
            want.append((r.doc_id, "\n".join(out), r.lang, r.source, len("\n".join(out))))
    assert sorted(map(tuple, after)) == want and len(after) < len(before)


def test_minhash(runs):
    before, after = runs["minhash"]
    sets, index = {}, {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text_of(r)))
        sets[r.doc_id] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            index.setdefault(s, []).append(r.doc_id)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in Counter(p for own in index.values() for p in itertools.combinations(sorted(own), 2)).items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert sorted(after) == sorted(r for r in before if find(r.doc_id) == r.doc_id)


def test_mixing(spark, runs):
    before, after = runs["mixing"]
    times = Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    decided = {r.doc_id: r.copies for r in mixing.decide(spark.createDataFrame(before, spark.read.parquet(f"{SMALL}/documents.parquet").schema)).collect()}
    assert {r.doc_id: n for r, n in times.items()} == {i: n for i, n in decided.items() if n}


def test_bpe(runs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    before, after = runs["bpe"]
    want = []
    for r in before:
        ids = t.encode(text_of(r), add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), *[hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]))
    assert sorted(map(tuple, after)) == sorted(want)


def test_run_is_the_stages(spark):
    out = pipeline.run(spark, TINY)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count()


def edge_table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", s, None, *["x"] * len(EXTRA)) for i, t, s in rows], schema)


LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, "one two three four five six", "a"), (4, "one two three four five six", "a"), (4, "another text with its own words here", "b"),
    (5, "one two three  four five six", "a"), (None, "one two three four five six", "b"), (6, LONG, "b"), (None, LONG + " end", None), (7, "x\nrepeated line here\ny", "c"), (8, "z\nrepeated line here\nu", "c"),
]


def test_edges(spark):
    docs = edge_table(spark, ROWS)
    kept = STAGE["quality"](spark, docs, TINY)
    assert kept.columns == pipeline.COLUMNS and kept.count() <= len(ROWS)
    out = STAGE["line_dedup"](spark, docs, TINY)
    assert out.columns == pipeline.COLUMNS
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.where("text is not null").collect())
    # The null id stands first: its line of six words stays, and every later copy goes with its document.
    assert got == sorted([(0, "one two three four five six", 27), (0, LONG + " end", len(LONG) + 4), (2, "", 0), (3, " \n\t", 3), (4, "another text with its own words here", 36), (6, LONG, len(LONG)), (7, "x\nrepeated line here\ny", 22), (8, "z\nu", 3)])
    out = STAGE["minhash"](spark, docs, TINY)
    assert out.columns == pipeline.COLUMNS
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.text or "")[:9]) for r in out.collect())
    # Of four rows alike one stays, of a long text and its near copy the one with an id; rows without words stay.
    assert got == [((False, 1), ""), ((False, 2), ""), ((False, 3), " \n\t"), ((False, 4), "another t"), ((False, 4), "one two t"), ((False, 6), "w0 w1 w2 "), ((False, 7), "x\nrepeate"), ((False, 8), "z\nrepeate")]
    mixed = STAGE["mixing"](spark, docs, TINY)
    assert mixed.columns == pipeline.COLUMNS and {r.text for r in mixed.collect()} <= {t for _, t, _ in ROWS}
    assert STAGE["bpe"](spark, docs, TINY).count() == len(ROWS)


def test_near_dedup_keeps_other_columns(spark):
    docs = edge_table(spark, ROWS).withColumn("_key0", F.lit("k"))
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == 8 and out.where("_key = 'x' and _key0 = 'k' and kept = 'x'").count() == 8


def test_operators_with_clashing_columns(spark):
    """Columns that operators use inside or add do not disturb them; those that an operator adds are replaced."""
    docs = edge_table(spark, ROWS)
    out = linedup.dedup(docs)
    assert out.columns == [c for c in docs.columns if c != "n_deleted"] + ["n_lines", "n_deleted", "n_runs", "longest_run"] and out.where("_cut = 'x' and _h = 'x'").count() == len(ROWS)
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c not in ("size", "target", "copies")] + ["size", "source_size", "target", "copies"] and out.where("text_hash = 'x'").count() == len(ROWS)
    labels = spark.read.parquet(f"{TINY}/labels.parquet").withColumn("text", F.lit("x")).withColumn("score", F.lit(1))
    out = quality.score(docs, quality.fit(docs, labels, F.lit(True)), held_out=F.lit(False))
    assert out.columns == [c for c in docs.columns if c not in ("held_out", "score", "predicted")] + ["held_out", "score", "predicted"] and out.where("kept = 'x'").count() == len(ROWS)
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), held_out=F.lit(False)).count() == len(ROWS)
    for df in (media.digests(docs), media.tensors(docs).select("doc_id").distinct(), minhash.near_duplicates(docs)):
        assert df.count() > 0
    found = docs.withColumn("text", F.lit("token = b7db7aa4a5fcc7830591")).withColumns({c: F.lit("x") for c in ("path", "kind", "value", "before", "left", "right", "label", "dictionary", "piece", "_text")})
    assert secrets.scan(found, secrets.made_findings(spark)).where("secret").count() == len({(i, s) for i, _, s in ROWS})
    vectors = spark.createDataFrame([(1, [1.0, 2.0], "x", "x", "x"), (2, [2.0, 4.0], "x", "x", "x")], "vec_id long, embedding array<double>, kept string, c string, v string")
    assert [tuple(r) for r in embed_dedup.near_duplicates(vectors).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]
    pages = spark.createDataFrame([(1, "u", "h", "x", "x")], "page_id long, url string, html string, file string, body string")
    assert warc.audit(*[warc.records(pages, 1)] * 2).count() == 1


def test_empty_table(spark):
    none = edge_table(spark, [])
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, TINY)
        assert out.count() == 0 and (name == "bpe" or out.columns == pipeline.COLUMNS)


def test_no_labels(spark, tmp_path):
    spark.read.parquet(f"{TINY}/labels.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "labels.parquet"))
    assert STAGE["quality"](spark, edge_table(spark, ROWS), str(tmp_path)).count() == len(ROWS)
