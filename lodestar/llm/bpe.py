"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word the byte-pair encoding has one last token. A multi-pattern automaton over the vocabulary (a
trie with suffix links) names every token that ends at a prefix; the first of them that agrees with the last token of
what stands before it is stored, and following the stored tokens back from the end gives the exact ids. Two tokens agree
if byte-pair merging of their joined symbols would leave them as they are, which a walk down both merge trees tells.

Words recur, so a task keeps what it has encoded by pre-token, in two generations of bounded size, and forgets it at its end.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release, tune

KEPT_PIECES = 250_000
KEPT_PAIRS = 1_000_000
#: Longer words go through the same tables without being kept.
KEPT_LENGTH = 64
FINAL = 0xE000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next of U+0100 and on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, n = dict.fromkeys(prints), 0
    for b in range(256):
        if b not in shown:
            shown[b], n = 256 + n, n + 1
        else:
            shown[b] = b
    return [chr(shown[b]) for b in range(256)]


class WordBpe:
    """The tokenizer of a `tokenizers` file: lower case, byte-level words, merges with a word end."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.ids = {t: i for i, t in self.text.items()}
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.end: str = model["end_of_word_suffix"]
        self.symbols = byte_symbols()
        # Ranks order the tokens: base symbols first, then merges as listed.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in merges]
        merged = set(made)
        base = [t for t in self.vocab if t not in merged]
        self.rank = {t: r for r, t in enumerate([*base, *made])}
        self.vocab_id = [self.vocab[t] for t in [*base, *made]]
        self.parts = [(r, r) for r in range(len(base))] + [(self.rank[a], self.rank[b]) for a, b in merges]
        self.pairs = {(self.rank[a], self.rank[b]): self.rank[a + b] for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            if word := self.single(t):
                self.automaton.add_word(word, (r, len(word)))
        self.automaton.make_automaton()
        self.agree: dict[int, bool] = {}
        self.kept: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def single(self, token: str) -> str:
        """One character a symbol: the last one of a word has its own."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(FINAL + ord(body[-1]))
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both tokens gives just these two."""
        bound = len(self.parts)
        while True:
            if self.pairs.get((left, right), bound) < bound:
                return False
            # Undo the later of the two merges; merges across the border must now come before it.
            first_left = left > right
            for side in (first_left, not first_left):
                if side and self.parts[left][1] != left:
                    bound, left = left, self.parts[left][1]
                    break
                if not side and self.parts[right][0] != right:
                    bound, right = right + 1, self.parts[right][0]
                    break
            else:
                return True

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        s = piece if piece.isascii() and piece.isprintable() else "".join([self.symbols[b] for b in piece.encode("utf-8")])
        s = s[:-1] + chr(FINAL + ord(s[-1]))
        last: list[int] = [-1] * len(s)
        size = [0] * len(s)
        agree = self.agree
        for end, (token, n) in self.automaton.iter(s):
            if last[end] < 0:
                start = end - n + 1
                if start:
                    key = last[start - 1] << 20 | token
                    ok = agree.get(key)
                    if ok is None:
                        if len(agree) > KEPT_PAIRS:
                            agree.clear()
                        ok = agree[key] = self.compatible(last[start - 1], token)
                    if not ok:
                        continue
                last[end], size[end] = token, n
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(self.vocab_id[last[at]])
            at -= size[at]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a whole text, in order; pieces never cross white space."""
        if "<|" not in text:
            return self._split(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.special else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def forget(self) -> None:
        for kept in (self.kept, self.older, self.agree):
            kept.clear()
        release()

    def ids_of(self, piece: str) -> list[int]:
        return [self.special[piece]] if piece in self.special else self.word(piece)

    def _miss(self, piece: str) -> tuple[str, str]:
        """Both generations of kept pieces are bounded; frequent pieces move on from one to the next."""
        if (got := self.older.get(piece)) is None:
            ids = self.ids_of(piece)
            got = ("".join([f" {i}" for i in ids]), "".join([f" {self.text[i]}" for i in ids]))
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text or "") for i in self.ids_of(p)]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: tokens joined by a space; ids out of the vocabulary give nothing."""
        return " ".join(self.text[i] for i in ids if i in self.text)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, digest of the ids, digest of the decoded text)."""
        get, miss = self.kept.get, self._miss
        got = [get(p) or miss(p) for p in self.pieces(text or "")]
        ids, tokens = "".join([x[0] for x in got]), "".join([x[1] for x in got])
        return ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(tokens[1:].encode()).hexdigest()


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file on this machine."""
    return _loaded(Path(path).read_bytes())


def _loaded(file: bytes) -> WordBpe:
    key = hashlib.sha256(file).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(file)
    return _LOADED[key]


def _sent(docs: DataFrame, path: str) -> Broadcast:
    """The file's bytes (a few MB), read on the driver: executors need not have it."""
    tune(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column `ids` (array of int) added in place of any of that name. A null text counts as empty; rows, repeated ones too, stay one for one."""
    file = _sent(docs, path)

    @F.pandas_udf("array<int>")
    def run(x):
        return x.map(_loaded(file.value).encode)

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of the column `ids`; null ids give an empty text."""
    file = _sent(docs, path)

    @F.pandas_udf("string")
    def run(x):
        t = _loaded(file.value)
        return x.map(lambda i: t.decode([] if i is None else list(i)))

    return docs.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: one narrow pass, no shuffle.

    A null text counts as empty; a very long one is encoded whole, word by word; rows, repeated ones and null ids too, stay
    one for one; columns other than doc_id and text are not looked at; an empty table gives an empty one.
    """
    file = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file.value)
        for b in lean(batches):
            n, i, d = zip(*map(t.digest, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )
        t.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
