"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sieveline.session import ship

from .common import column, trim

#: Symbols of a text parsed at a time; a longer text is parsed in blocks, which adds a phrase for each at most.
BLOCK = 1024


def suffix_automaton(texts: list[list[int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of all substrings of the texts: number of states, and state, symbol and next state of each arc.

    State 0 is the root. There are at most two states and three arcs for each symbol of the texts.
    """
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for text in texts:
        last = 0
        for c in text:
            q = after[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(after)
                after.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in after[p]:
                    after[p][c] = new
                    p = link[p]
            else:
                new, p = -1, last
            if p >= 0:
                q = after[p][c]
                if length[q] != length[p] + 1:
                    clone = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = clone
                        p = link[p]
                    link[q] = clone
                    q = clone
                if new >= 0:
                    link[new] = q
            last = new if new >= 0 else q
    sizes = np.fromiter(map(len, after), np.int64)
    symbol, to = (np.fromiter(chain.from_iterable(x), np.int64, int(sizes.sum())) for x in (after, (x.values() for x in after)))
    return len(after), np.repeat(np.arange(len(after)), sizes), symbol, to


class Arcs:
    """Next states by (state, symbol), -1 if there is none: a whole table if it has at most `most` bytes, else a hash table of the
    arcs alone, which takes no more space for a large alphabet."""

    def __init__(self, states: int, symbols: int, start: np.ndarray, symbol: np.ndarray, to: np.ndarray, most: int = 64 << 20) -> None:
        self.symbols = symbols
        keys = start * symbols + symbol
        self.table = self.keys = None
        if 4 * states * symbols <= most:
            self.table = np.full(states * symbols, -1, np.int32)
            self.table[keys] = to
            return
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            took = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[took]], self.to[slot[took]] = keys[took], to[took]
            left = np.ones(len(keys), bool)
            left[took] = False
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        keys = state * self.symbols + symbol
        if self.table is not None:
            return self.table[keys]
        flat = keys.ravel()
        slot = self._slot(flat)
        out, at = np.full(len(flat), -1, np.int32), np.arange(len(flat))
        while len(at):
            held = self.keys[slot]
            hit = held == flat[at]
            out[at[hit]] = self.to[slot[hit]]
            on = ~hit & (held >= 0)
            at, slot = at[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(keys.shape)


class LanguageModel:
    """Suffix automata of labelled texts, one for each language, over one alphabet of lower-case letters and a separator."""

    def __init__(self, samples: dict[str, list[str]], most: int = 64 << 20) -> None:
        self.languages = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in map(_lower, t) if c.isalpha()})
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.unknown = len(code) + 1
        self.symbol = np.zeros(0x110000, np.int32)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)
        for c in np.flatnonzero(self.letter):
            self.symbol[c] = code.get(_lower(chr(c)), self.unknown)
        arcs, roots, scale, at = [], [], [], 0
        for name in self.languages:
            coded = [self.symbols(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in samples[name]]
            states, start, symbol, to = suffix_automaton([c[c != self.unknown].tolist() for c in coded])
            arcs.append((start + at, symbol, to + at))
            roots.append(at)
            scale.append(math.log2(max(2, sum(map(len, coded)))))
            at += states
        self.arcs = Arcs(at, self.unknown + 1, *(np.concatenate([x[i] for x in arcs] or [np.zeros(0, np.int64)]) for i in range(3)), most)
        self.roots, self.scale = np.array(roots, np.int64), np.array(scale)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        s = self.symbol[points]
        if len(s):
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
            s = s[keep]
        return s

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """For each language and block, the number of phrases: longest stretches that occur in the language's texts."""
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        width = int(sizes.max(initial=0))
        grid = np.zeros((len(blocks), width), np.int32)
        for i, b in enumerate(order):
            grid[i, : sizes[b]] = blocks[b]
        grid = np.ascontiguousarray(grid.T)
        active = np.searchsorted(-sizes[order], -np.arange(1, width + 1), "right")
        root = np.repeat(self.roots[:, None], len(blocks), 1)
        state, count = root.copy(), np.zeros(root.shape, np.int32)
        for k in range(width):
            n = active[k]
            s, r, c = state[:, :n], root[:, :n], grid[k, :n]
            to = self.arcs.follow(s, c)
            dead = to < 0
            if dead.any():
                i, j = np.nonzero(dead)
                count[i, j] += s[i, j] != r[i, j]  # the phrase before this symbol has ended
                again = self.arcs.follow(r[i, j], c[j])
                count[i, j] += again < 0  # a symbol the language doesn't have is a phrase of its own
                to[i, j] = np.where(again < 0, r[i, j], again)
            state[:, :n] = to
        count += state != root
        out = np.zeros_like(count)
        out[:, order] = count
        return out

    def has_letter(self, text: str) -> bool:
        return bool(self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores, blocks, owner = ["und"] * len(texts), [0.0] * len(texts), [], []
        total = np.zeros(len(texts))
        for i, t in enumerate(texts):
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            if self.languages and self.letter[points].any():
                s = self.symbols(points)
                total[i] = len(s)
                for lo in range(0, len(s), BLOCK):
                    blocks.append(s[lo : lo + BLOCK])
                    owner.append(i)
        if blocks:
            found = np.zeros((len(self.languages), len(texts)))
            for lo in range(0, len(blocks), 2048):
                part = self.phrases(blocks[lo : lo + 2048])
                for row, x in zip(found, part, strict=True):
                    row += np.bincount(owner[lo : lo + 2048], x, len(texts))
            cost = found * self.scale[:, None]
            best = np.argmin(cost, 0)
            ranked = np.sort(cost, 0)
            for i in np.flatnonzero(total):
                names[i] = self.languages[best[i]]
                scores[i] = float(1 - ranked[0, i] / ranked[1, i]) if len(self.languages) > 1 else 1.0
        return names, scores


    def predict_all(self, texts: pa.Array, size: int = 1 << 21) -> tuple[list[str], list[float]]:
        """predict, for texts of about `size` characters at a time."""
        names, scores, part, held = [], [], [], 0
        for x in texts:
            part.append(x.as_py() or "")
            held += len(part[-1])
            if held > size:
                a, b = self.predict(part)
                names, scores, part, held = names + a, scores + b, [], 0
        a, b = self.predict(part)
        return names + a, scores + b


def _lower(c: str) -> str:
    return c.lower()[:1]


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text 2 modulo 4 (false for null)?"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, bins: int = 64, points: int = 32_000, whole: int = 32, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of labelled rows that aren't held out.

    For each language, `bins` hash ranges of ids give one row each, of which a stretch of `points` / `bins` code points, at a
    place by hash, is learned from. Beyond `whole` languages stretches get shorter, so that all automata together keep to the
    size of `whole` full ones, but no language gets less than a sixteenth of a full one.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    h, size = F.xxhash64(F.lit(11), F.col(id_col)), points // bins
    begin = 1 + F.pmod(F.xxhash64(F.lit(12), F.col(id_col)), F.greatest(F.length(text_col) - size, F.lit(0)) + 1)
    one = F.min(F.struct(h.alias("h"), F.substring(F.col(text_col), begin.cast("int"), F.lit(size)).alias("t"))).alias("x")
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows.groupBy(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(bins)).alias("bin")).agg(one).select("lang", "x.h", "x.t").collect():
        found.setdefault(r["lang"], []).append((r["h"], r["t"]))
    share = max(size // 16, min(size, size * whole // max(1, len(found))), 1)
    return LanguageModel({name: [t[:share] for _, t in sorted(x)] for name, x in found.items()})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred and score.

    The language whose automaton needs the fewest phrases, times the bits to point at one, wins; ties go to the first by
    name. The score is one less the winner's cost over the runner-up's (1 if there is one language). Text that is null or has
    no letter is `und` with score 0, and so is all text if nothing was learned. Null and repeated ids are kept as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = m.predict_all(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        trim()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told (see identify), with that language in lang_col; others go. No shuffle.

    If nothing was learned, rows with a letter stay as they are.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(lang_col)
            if m.languages:
                names, _ = m.predict_all(column(batch, text_col))
                batch = batch.set_column(at, batch.schema.field(at), pa.array(names, pa.string()).cast(batch.schema.field(at).type))
                stay = [n != "und" for n in names]
            else:
                stay = [m.has_letter(x.as_py() or "") for x in column(batch, text_col)]
            yield batch.filter(pa.array(stay, pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, **kw) -> DataFrame:
    """Learn from the labelled rows of docs and predict the language of every row."""
    return identify(docs, learn(docs, **kw))
