"""BPE encoding and decoding by an automaton over tokens, compiled from the merges gadget by gadget."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sieveline.session import ship

from .common import column, trim

#: Fixed: white space as the tokenizer's patterns see it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Automaton:
    """A deterministic automaton whose arcs are tokens and whose paths are exactly the token sequences that BPE makes.

    It starts as one state with an arc for every base symbol. The gadget of a merge (a, b) takes the arc b from the state that
    follows a and lets the new token ab lead, from wherever a led on to b, to where b leads. A token's target state thus
    is that of its right part, less the arcs removed after the token came into being; a token's arc leaves a state unless
    one of its left parts was removed before that part was merged away (or by the same merge: of overlapping pairs of one
    token with itself the left one merges). So states hold only the arcs removed by their own
    gadgets, with the time, and refer to their right part for the rest. Words are followed arc by arc; exactly one path ends
    with the word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix, self.label = suffix, {i: t for t, i in vocab.items()}
        n = max(vocab.values()) + 1
        self.left, self.right, self.born = [-1] * n, [-1] * n, [_NEVER] * n
        self.removed: list[dict[int, int] | None] = [None] * n
        for time, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.left[k] < 0 and self.leads(i, j, time):
                if self.removed[i] is None:
                    self.removed[i] = {}
                self.removed[i][j] = time
                self.left[k], self.right[k], self.born[k] = i, j, time
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(suffix) or t == suffix}
        self.final = {t[: -len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix) and t != suffix}
        self.longest: dict[str, int] = {}
        for t in chain(self.inner, self.final):
            if len(t) > 3:
                self.longest[t[:4]] = max(self.longest.get(t[:4], 4), len(t))
        self._known: dict[int, bool] = {}

    def leads(self, a: int, b: int, now: int = _NEVER) -> bool:
        """Does the state that follows token a have an arc for token b (at a time of the construction)?"""
        limit = now
        while a >= 0:
            gone = self.removed[a]
            if gone:
                c, until = b, _NEVER
                while c >= 0:
                    time = gone.get(c, _NEVER)
                    if time < limit and time <= until:
                        return False
                    until = min(until, self.born[c])
                    c = self.left[c]
            limit = min(limit, self.born[a])
            a = self.right[a]
        return True

    def _learn(self, key: int) -> bool:
        if len(self._known) > 200_000:
            self._known.clear()
        known = self._known[key] = self.leads(key >> 20, key & 0xFFFFF)
        return known

    def path(self, word: str) -> list[int]:
        """The tokens of one pre-split word in byte symbols."""
        n, inner, final, longest, known, learn = len(word), self.inner, self.final, self.longest, self._known, self._learn
        out: list[int] = []
        ends: list[int] = []
        at, upto, last = 0, n, -1
        while True:
            # No token from here is longer than the longest one that begins with these four characters, or than three.
            most = at + longest.get(word[at : at + 4], 3)
            if upto > most:
                upto = most
            while upto > at:
                t = (inner if upto < n else final).get(word[at:upto])
                if t is not None:
                    if last < 0:
                        break
                    key = last << 20 | t
                    leads = known.get(key)
                    if leads or (leads is None and learn(key)):
                        break
                upto -= 1
            if upto > at:
                out.append(t)
                if upto == n:
                    return out
                ends.append(at)
                at, upto, last = upto, n, t
            else:
                if not out:
                    raise ValueError(f"no path for {word!r}")
                out.pop()
                upto, at = at - 1, ends.pop()
                last = out[-1] if out else -1


class Tokenizer:
    """The tokenizer of a `tokenizers` JSON file with a word-end suffix, byte symbols and no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", _SPACE)
        self.symbols = byte_symbols()
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _tools(self):
        if self._ready is None:
            split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
            # str.split() also cuts at the characters of the first pattern, which aren't white space here.
            self._ready = re.compile("[\x1c-\x1f]"), split, self._stretches(), re.compile(f"[{_SPACE}]")
        return self._ready

    def _stretches(self) -> _Recent:
        """Tokens of the stretches between white space; their words are remembered by themselves, as punctuation differs more."""
        split, path, bytes_ = regex.compile(self.pattern).findall, self.automaton.path, dict(enumerate(self.symbols))

        def word(w: str) -> tuple[int, ...]:
            return tuple(path(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(bytes_)))

        words = _Recent(word, 150_000)

        def stretch(s: str) -> tuple[int, ...]:
            if s.isascii() and s.isalpha():
                return words[s]
            return tuple(chain.from_iterable(map(words.__getitem__, split(s))))

        return _Recent(stretch, 300_000)

    def forget(self) -> None:
        """Drop the words met so far."""
        self._ready = None
        self.automaton._known.clear()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        odd, split, cache, space = self._tools()
        found: list = []
        for piece in split.split(text) if split and "<|" in text else (text,):
            if piece in self.special:
                found.append((self.special[piece],))
                continue
            while piece:
                cut = len(piece)
                if cut > 1 << 20:  # a long text goes in pieces cut at white space
                    m = space.search(piece, 1 << 20)
                    cut = m.start() if m else cut
                part, piece = piece[:cut], piece[cut:]
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                found.extend(map(cache.__getitem__, space.split(part) if odd.search(part) else part.split()))
        return np.fromiter(chain.from_iterable(found), np.int32)

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


class _Recent(dict):
    """What `make` gives for the keys met lately, at most about `most` of them."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int) -> None:
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>) and decoded (text of the ids).

    Null and empty texts have no ids and decode to "". Rows with null or repeated ids are encoded like others; other columns
    are ignored. The driver compiles the automaton from the file at `path` and broadcasts it; its size is the vocabulary's.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = [t.encode(x.as_py() or "") for x in column(batch, "text")]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([t.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        t.forget()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, path: str, **kw) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    d = bpe_encode(docs, path, **kw)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
