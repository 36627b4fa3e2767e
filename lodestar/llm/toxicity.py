"""Toxicity: a lexicon learned from labels, Levenshtein automata over its trie, scores from context windows.

1. From a bounded sample of labelled documents, words and word beginnings that stand almost only in toxic documents are
   counted on the executors and chosen on the driver (a bounded table). Near copies count once, by a sketch of the text.
2. The terms form a trie. A Levenshtein automaton of distance one runs along the trie; their product is made
   deterministic state by state as words ask for it, so that most words leave it after two or three letters.
3. Each occurrence is read with the words around it: inside quotation marks or after a verb of speaking it counts as
   quoted, else as direct. A ridge-penalised logistic model weighs direct, misspelled and quoted terms.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, tune
from .labelled import MOST_LABELLED, sample

WORD = re.compile(r"[^\W\d_]+")
#: A word with digits or signs inside; it is matched as one where none of its parts is a term.
MASKED = re.compile(r"[^\W\d_]+(?:[\d_*@$]+[^\W\d_]+)+")
#: What stands between two letters of a masked word: looked for first, as most texts have none.
BETWEEN = re.compile(r"(?<=[^\W\d_])[\d_*@$]+(?=[^\W\d_])")
TOKEN = re.compile(r"[^\W\d_]+(?:[\d_*@$]+[^\W\d_]+)*")
#: A term is a whole word, or a beginning of so many letters that longer words share.
BEGINNINGS = range(3, 9)
PRECISION = 0.9
#: A toxic text that holds so many chosen terms calls for no more; a term that no other text calls for is left out.
COVER = 6
KEPT_WORDS = 400_000
#: Letters of the shortest word that may stand for a longer term.
SHORTEST = 4
#: Words before an occurrence that are looked at, and verbs of speaking (fixed values).
WINDOW = 5
SPEAKING = frozenset(
    "said says saying wrote writes called calls quoted quotes quote word term dit disait appelle sagte schrieb nannte wort dijo llama palabra".split()
)
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
FEATURES = ("exact", "begins", "misspelled", "quoted", "any_direct", "share")


class Automaton:
    """Product of a lexicon's trie and the Levenshtein automaton of one edit, made deterministic as it is used.

    A state is a set of (trie node, edit): 0 for none so far, 1 for one, 2 for one with a letter matched since. Words of at
    least `shortest` letters (`fuzzy`, if not given) may differ by one edit from terms and beginnings of at least `fuzzy`
    letters. The edit of a beginning must have a matched letter of it after it, or a shorter beginning would do.
    """

    def __init__(self, terms: dict[str, float], spared: Iterable[str] = (), fuzzy: int = 5, shortest: int | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.begin: list[str | None] = [None]
        self.deep: list[bool] = [False]
        self.spared = frozenset(spared)
        for t in sorted(terms):
            body, at, path = t.rstrip("*"), 0, [0]
            for c in body:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({}), self.word.append(None), self.begin.append(None), self.deep.append(False)
                at = self.children[at][c]
                path.append(at)
            if t.endswith("*"):
                self.begin[at] = t
            else:
                self.word[at] = t
            if len(body) >= fuzzy:
                for p in path:
                    self.deep[p] = True
        self.fuzzy = fuzzy
        self.shortest = fuzzy if shortest is None else shortest
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        #: Of each state, the beginning that ends there as it is, and one that ends there with an edit.
        self.starts: list[tuple[str | None, str | None]] = []
        self._state(self._closed({(0, 0)}))

    def _closed(self, now: set[tuple[int, int]]) -> frozenset:
        """Also the states after a letter of the term is left out."""
        now |= {(x, 1) for n, e in list(now) if e == 0 for x in self.children[n].values() if self.deep[x]}
        return frozenset((n, e) for n, e in now if e == 0 or (n, 0) not in now and (e == 2 or (n, 2) not in now))

    def _state(self, key: frozenset) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            as_is = max((self.begin[n] for n, e in key if e == 0 and self.begin[n]), key=len, default=None)
            near = max((b for n, e in key if e == 2 and (b := self.begin[n]) and len(b) > self.fuzzy), key=lambda b: (len(b), b), default=None)
            self.starts.append((as_is, near))
        return self.ids[key]

    def _step(self, s: int, c: str) -> int:
        to: set[tuple[int, int]] = set()
        for n, e in self.states[s]:
            if (x := self.children[n].get(c)) is not None and (e == 0 or self.deep[x]):
                to.add((x, 2 if e else 0))
            if e == 0:
                if self.deep[n]:
                    to.add((n, 1))
                to |= {(x, 1) for x in self.children[n].values() if self.deep[x]}
        if not to:
            return -1
        return self._state(self._closed(to))

    def match(self, w: str) -> tuple[str, str] | None:
        """(kind, term): the whole word, else the longest beginning, else a term at one edit, else a beginning at one."""
        s, begin, near, table = 0, None, None, self.next
        for c in w:
            t = table[s].get(c)
            if t is None:
                t = table[s][c] = self._step(s, c)
            s = t
            if s < 0:
                break
            as_is, edited = self.starts[s]
            begin, near = as_is or begin, edited or near
        ends = sorted((min(e, 1), self.word[n]) for n, e in self.states[s] if self.word[n]) if s >= 0 else []
        if ends and ends[0][0] == 0:
            return "exact", ends[0][1]
        if begin:
            return "begins", begin
        if len(w) < self.shortest or w in self.spared:
            return None
        for _, t in ends:
            if len(t) >= self.fuzzy:
                return "misspelled", t
        return ("misspelled", near) if near else None


@dataclass
class Model:
    terms: dict[str, float]
    spared: list[str]
    weights: list[float]
    _auto: Automaton | None = field(default=None, repr=False)
    _clean: set[str] = field(default_factory=set, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "spared": self.spared, "weights": self.weights, "_auto": None, "_clean": set()}

    def hits(self, text: str) -> dict[str, tuple[str, str]]:
        if self._auto is None:
            self._auto = Automaton(self.terms, self.spared, shortest=SHORTEST)
        low = text.lower()
        words, found = set(WORD.findall(low)), {}
        if len(self._clean) > KEPT_WORDS:
            self._clean.clear()
        for w in words - self._clean:
            if (m := self._auto.match(w)) is None:
                self._clean.add(w)
            else:
                found[w] = m
        for w in set(MASKED.findall(low)) - self._clean if BETWEEN.search(low) else ():
            if not any(x in found for x in WORD.findall(w)):
                if (m := self._auto.match(w)) is None or m[0] != "misspelled":
                    self._clean.add(w)
                else:
                    found[w] = m
        return found

    def features(self, text: str) -> list[float]:
        found = self.hits(text)
        if not found:
            return [0.0] * len(FEATURES)
        low, n, quoted, total = text.lower(), Counter(), 0, 0
        spans = quotations(low)
        at, before = 0, []
        for start, w in occurrences(low, found):
            total += 1
            if w in found:
                while at < len(spans) and spans[at][1] <= start:
                    at += 1
                if at < len(spans) and spans[at][0] < start or SPEAKING.intersection(before):
                    quoted += 1
                else:
                    n[found[w][0]] += 1
            before = [*before[1 - WINDOW :], w]
        direct = sum(n.values())
        return [
            math.log1p(n["exact"]), math.log1p(n["begins"]), math.log1p(n["misspelled"]), math.log1p(quoted), float(direct > 0),
            math.log1p(1000 * direct / total)
        ]

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(a * b for a, b in zip(self.weights, self.features(text), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def occurrences(text: str, found: dict) -> Iterator[tuple[int, str]]:
    """(start, word) in order; a word with signs inside is one where it is found as such, else its parts."""
    for m in TOKEN.finditer(text):
        if m.group() in found:
            yield m.start(), m.group()
        else:
            yield from ((x.start(), x.group()) for x in WORD.finditer(text, m.start(), m.end()))


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks on one line."""
    out, at = [], 0
    for m in re.finditer("[" + "".join(QUOTES) + "]", text):
        if m.start() < at:
            continue
        line = text.find("\n", m.end())
        end = text.find(QUOTES[m.group()], m.end(), line if line >= 0 else len(text))
        if end >= 0:
            out.append((m.start(), end))
            at = end + 1
    return out


def sketch(words: list[str]) -> int:
    """The same for most near copies: the least hash of three words in a row; of fewer words, the hash of all."""
    return min((hash3(a) for a in zip(words, words[1:], words[2:], strict=False)), default=None) or hash3(tuple(words))


def hash3(x: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(x).encode(), digest_size=6).digest(), "big")


def terms_of(text: str) -> set[str]:
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def sketched(rows: DataFrame) -> DataFrame:
    """rows (text, y) with the sketch of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            own = [sketch(WORD.findall(t.lower())) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int64())], ["text", "y", "sketch"])

    return rows.select("text", "y").mapInArrow(run, "text string, y int, sketch long")


def term_counts(rows: DataFrame, y: int, among: frozenset[str] | None = None) -> DataFrame:
    """(term, n): in how many sketches of documents with label y a term (one of `among`) stands.

    Rows of one sketch come together first, so that each task sums before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        last, held = None, set()
        for b in lean(batches):
            for text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != last:
                    count.update(held)
                    last, held = own, set()
                held |= terms_of(text) if among is None else terms_of(text) & among
            if len(count) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
                count.clear()
        count.update(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    own = rows.where(F.col("y") == y).select("text", "sketch")
    each = own.repartition("sketch").sortWithinPartitions("sketch").mapInArrow(run, "term string, n long")
    return each.groupBy("term").agg(F.sum("n").alias("n"))


def surprise(toxic: int, clean: int, usual: float) -> float:
    """Minus the logarithm of the bound on so many toxic documents of all, where the usual share holds."""
    n = toxic + clean
    if not 0 < usual < 1 or toxic <= usual * n:
        return 0.0 if usual < 1 else math.inf
    q = toxic / n
    return n * (q * math.log(q / usual) + ((1 - q) * math.log((1 - q) / (1 - usual)) if clean else 0.0))


def choose_terms(rows: DataFrame) -> dict[str, float]:
    """Terms that stand almost only in toxic documents; none whose documents better terms have covered COVER times.

    Documents of one sketch count once, in every count.

    So many terms are tried that some stand in toxic documents by chance: a term must be rarer by chance (Chernoff's bound)
    than one in the number tried.
    """
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.countDistinct("sketch").alias("n")).collect()}
    toxic = n.get(1, 0)
    if not toxic:
        return {}
    usual = toxic / (toxic + n.get(0, 0))
    least = max(3, round(0.003 * toxic))
    often = term_counts(rows, 1).where(F.col("n") >= least).orderBy(F.desc("n"), F.length("term"), "term").collect()
    among = frozenset(r.term for r in often)
    clean = {r.term: r.n for r in term_counts(rows, 0, among).collect()}
    good = [
        (
            r.term, r.n, clean.get(r.term, 0)
        ) for r in often if r.n >= PRECISION * (r.n + clean.get(r.term, 0)) and surprise(r.n, clean.get(r.term, 0), usual) > math.log(len(often)) + 1
    ]
    score = {t: (a + 0.5) / (a + b + 1) * a for t, a, b in good}
    # Of a word, its beginnings and theirs, the one with the most toxic documents says all; the longest of equals.
    kept: dict[str, float] = {}
    for t in sorted(score, key=lambda t: (-score[t], -len(t.rstrip("*")), t)):
        body = t.rstrip("*")
        shorter = {body[:k] + "*" for k in BEGINNINGS}
        if shorter & kept.keys() or t.endswith("*") and any(k.startswith(body) and score[t] < 1.15 * score[k] for k in kept):
            continue
        kept[t] = score[t]
    names = list(kept)
    if not names:
        return {}
    where = {t: i for i, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(dict.fromkeys(names, 1.0), fuzzy=10**6)
        for b in lean(batches):
            out = []
            for text in b.column(0).to_pylist():
                words = set(WORD.findall(text.lower()))
                out.append(sorted({where[m[1]] for w in words if (m := auto.match(w))}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column(1)], ["terms", "sketch"])

    # Bounded by the sample: the toxic sketches' term numbers, to cover each sketch COVER times.
    each = rows.where("y = 1").select("text", "sketch").mapInArrow(run, "terms array<int>, sketch long")
    sets = [sorted(r.terms) for r in each.groupBy("sketch").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms")).orderBy("sketch").collect()]
    left = np.full(len(sets), COVER)
    rows_of: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            rows_of.setdefault(t, []).append(i)
    chosen: dict[str, float] = {}
    # Gains only fall: the best of the heap is the best of all where its own has not fallen.
    gain = lambda t: int((left[rows_of[t]] > 0).sum())
    heap = [(-len(rows_of[t]), t) for t in rows_of]
    heapq.heapify(heap)
    while heap:
        was, t = heapq.heappop(heap)
        now = gain(t)
        if now < least:
            continue
        if now < -was:
            heapq.heappush(heap, (-now, t))
            continue
        left[rows_of[t]] -= 1
        chosen[names[t]] = kept[names[t]]
    # The whole words beside a beginning, for words that lie one edit from them.
    return chosen | {t: x for t, x in score.items() if not t.endswith("*") and any(t[:k] + "*" in chosen for k in BEGINNINGS)}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED, rounds: int = 30) -> Model:
    """Learn from at most about `most` labelled documents whose ids `learn` accepts. Without toxic labels every score is low."""
    rows = sketched(sample(docs, labels, "toxic", learn, most)).persist()
    terms = choose_terms(rows)
    spared: list[str] = []
    if terms:
        model = Model(terms, [], [0.0])

        def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in lean(batches):
                got = Counter(w for text in b.column(0).to_pylist() for w, m in model.hits(text).items() if m[0] == "misspelled")
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["w", "n"])

        # Words of clean documents that lie one edit from a term are words of their own. Bounded by the sample.
        clean = rows.where("y = 0").select("text").mapInArrow(misspelled, "w string, n long")
        spared = [r.w for r in clean.groupBy("w").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "w").collect()]
    model = Model(terms, spared, [0.0])

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    # Like documents are summed: what reaches the driver is bounded by the sample.
    got = rows.select("text", "y").mapInArrow(feats, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    rows.unpersist()
    model.weights = logistic([(r.x, r.y == 1, r.n) for r in got], rounds)
    return model


#: What the weights are drawn to where the labels say nothing: abuse raises a score, quotation raises it less.
PRIOR = (1.5, 1.5, 1.0, 0.2, 2.0, 0.2, -3.0)


def logistic(rows: list, rounds: int, ridge: float = 1.0) -> list[float]:
    w = np.array(PRIOR)
    if not rows:
        return w.tolist()
    rows = sorted(rows, key=lambda r: (list(r[0]), r[1]))
    x = np.array([[*r[0], 1.0] for r in rows])
    y, n = np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * (w - PRIOR)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w.round(9).tolist()


def score(docs: DataFrame, model: Model, *, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text: one narrow pass.

    A null text counts as empty and scores as a text without any term; very long texts are read whole, a batch of bounded
    size at a time; repeated rows give equal rows, and columns other than doc_id and text are not looked at.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            s = [model.score(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
