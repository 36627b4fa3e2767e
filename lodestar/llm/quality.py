"""Quality: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import Scratch, lean, tune
from .labelled import MOST_LABELLED, sample

N_FOURIER = 256
#: Parts that the normal equations are summed in; each sends one matrix to the driver.
PARTS = 16
STATISTICS = 20

_CLASS = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        _c.isupper() and _b < 128, _c.islower() and _b < 128, _c.isdigit() and _b < 128, _b in (9, 11, 12, 13, 32), _b == 10,
        _c in ".,;:?'\"-()", _c == "!", _b < 128 and _c in "#$%&*+/<=>@[\\]^_`{|}~", _b >= 128
    ]


def statistics(text: str) -> list[float]:
    """Shares and logarithms that describe a whole text; an empty one gives zeros."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * STATISTICS
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)).tolist()
    words = text.split()
    n = len(words)
    if not n:
        return [*shares, np.log1p(len(raw)), *[0.0] * (STATISTICS - 10)]
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    sizes = Counter(map(len, words))
    letters = sum(k * v for k, v in sizes.items())
    mean = letters / n
    spread = (sum(v * (k - mean) ** 2 for k, v in sizes.items()) / n) ** 0.5
    return [
        *shares, np.log1p(len(raw)), np.log1p(n), mean, spread, len(count) / n, max(count.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        text.count(". ") / n, sum(v for k, v in sizes.items() if k <= 3) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * (2 / self.omega.shape[1]) ** 0.5, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.interp(self.raw(np.array([statistics(t or "") for t in texts])), self.knots, self.values)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values: pooled adjacent violators, each pool smoothed by half a row of either label."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, label in zip(score[order], y[order], strict=True):
        pools.append([s, 1, label])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            s2, n2, y2 = pools.pop()
            s1, n1, y1 = pools[-1]
            pools[-1] = [(s1 * n1 + s2 * n2) / (n1 + n2), n1 + n2, y1 + y2]
    knots, values = np.array([p[0] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])
    return knots, np.clip(np.maximum.accumulate(values), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Learn from at most about `most` labelled documents; a fourth of them only calibrates. Without labels every score is 0.5."""
    spark = docs.sparkSession
    tune(spark)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))],
                ["doc_id", "y", "x"]
            )

    scratch = Scratch(spark, "quality")
    rows = scratch.save(sample(docs, labels, "quality", learn, most).mapInArrow(stats, "doc_id long, y int, x array<double>"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4 * PARTS)).cast("int"))

    def summed(frame: DataFrame, partial, width: int) -> np.ndarray:
        """The sum of partial(x, y) over parts of rows; PARTS matrices of fixed size reach the driver."""

        def run(key, t):
            t = t.sort_by("doc_id")
            x = np.array(t.column("x").to_pylist()).reshape(t.num_rows, -1)
            return pa.table({"part": [key[0].as_py()], "sum": [partial(x, t.column("y").to_numpy().astype(float)).tobytes()]})

        got = frame.select((F.col("part") % PARTS).alias("p"), "doc_id", "x", "y").groupBy("p").applyInArrow(run, "part long, sum binary").collect()
        return sum((np.frombuffer(r.sum).reshape(-1, width) for r in sorted(got, key=lambda r: r.part)), np.zeros((1, width)))

    moments = summed(rows, lambda x, y: np.vstack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)]), STATISTICS)
    rng = np.random.default_rng(seed)
    if moments.shape[0] == 1:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.full(1, 0.5))
    mean = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0))
    model = Model(
        mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(STATISTICS, N_FOURIER)) / STATISTICS**0.5,
        rng.uniform(0, 2 * np.pi, N_FOURIER), np.zeros(N_FOURIER + 1), np.zeros(1), np.full(1, 0.5)
    )

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.fourier(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    fit_on = rows.where("part >= 16") if rows.where("part >= 16").limit(1).count() else rows
    g = summed(fit_on, equations, N_FOURIER + 2)
    model.weights = np.linalg.solve(g[:, :-1] + ridge * np.eye(N_FOURIER + 1), g[:, -1])
    # Bounded by `most`: a score and a label of each row that calibrates.
    held = rows.where("part < 16").orderBy("doc_id").select("x", "y").collect() or rows.orderBy("doc_id").select("x", "y").collect()
    model.knots, model.values = isotonic(model.raw(np.array([r.x for r in held])), np.array([float(r.y == 1) for r in held]))
    scratch.drop_all()
    return model


def score(docs: DataFrame, model: Model, *, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """All columns of docs that are asked for, with held_out, score and predicted: one narrow pass.

    A null text scores as an empty one; rows stay one for one. Columns of these names that docs has are left out.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "_text")]
    rows = docs.withColumn("_held", held_out).select(*rest, F.col("_held").alias("held_out"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            s = model.score(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                [*b.schema.names[:-1], "score", "predicted"]
            )

    out = rows.drop("_text").schema.add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(run, out)
