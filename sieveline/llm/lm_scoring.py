"""Cross-entropy difference of documents under a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sieveline.session import ship

from .common import column, mix, pack_small, pack_sorted, parts_for, range_bounds, save, text_bytes, trim, unpack_small, unpack_sorted, word_chunks

_START = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text that one piece, and one range of keys, stand for.
PIECE = 9 << 20
#: Kinds of rows: a piece of the corpus, and counts by key of words, of words as first of a pair, and of pairs.
_BODY, _WORD, _FIRST, _PAIR = range(4)
_BODIES = "piece long, words binary, at binary, counts binary, ids array<long>, scored array<boolean>, target array<boolean>"
_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
_REPLIES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("piece", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("distinct", pa.int64()), ("n_words", pa.int64()), ("t_words", pa.int64())])


@dataclass(frozen=True)
class Shape:
    """What both models share. Words and pairs are counted exactly, whatever the shape."""

    words: int | None = None  #: size of the vocabulary in the add-one estimate; None takes the distinct words and one unknown
    weight: float = 0.7  #: of the bigram estimate against the unigram one


def _counts_of(b: bytes) -> np.ndarray:
    return unpack_small(b).astype(np.int64)


def _keys(words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ascending keys, key of each word of the texts) for words, words before and pairs; a text's first follows a start."""
    h = words[at]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = (np.cumsum(counts) - counts)[counts > 0]
    before[first] = _START
    firsts = np.insert(words, start := int(np.searchsorted(words, _START)), _START)
    which = np.empty_like(at)
    which[1:] = at[:-1] + (at[:-1] >= start)
    which[first] = start
    return [(words, at), (firsts, which), np.unique(mix(mix(before) + h), return_inverse=True)]


def _parts(parts: int) -> dict[int, int]:
    return {_WORD: -(-parts // 8), _FIRST: -(-parts // 8), _PAIR: parts}


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative numbers in the least whole bytes that hold them."""
    width = max(1, -(-int(x.max() if len(x) else 0).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(b: bytes) -> np.ndarray:
    full = np.zeros(((len(b) - 1) // b[0], 8), np.uint8)
    full[:, : b[0]] = np.frombuffer(b, np.uint8, -1, 1).reshape(-1, b[0])
    return full.view("<i8").ravel()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the corpus, a row each: distinct words as hashes, the words of all texts by them, and what marks the texts."""

    def piece() -> pa.RecordBatch:
        h, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        words, at = np.unique(h, return_inverse=True)
        marks = [[v for x in held for v in x[i].to_pylist()] for i in (2, 3, 4)]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, pack_sorted(words), _narrow(at), pack_small(counts), *marks), types, strict=True)], ["piece", "words", "at", "counts", "ids", "scored", "target"])

    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        for lo, hi, h, counts in word_chunks(column(batch, "text"), lower=True):
            held.append((h, counts, *(column(batch, c).slice(lo, hi - lo) for c in ("doc_id", "scored", "target"))))
            size += 6 * len(h) + 64 * (hi - lo)
            if size >= PIECE:
                yield piece()
                number, held, size = number + 1, [], 0
                trim()
    if held:
        yield piece()
    held = []
    trim()


def _asked(parts: int):
    """Rows of pieces to background and target counts of their keys, a row for each range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                words, at, counts = unpack_sorted(r["words"]), _widen(r["at"]), _counts_of(r["counts"])
                marks = [np.repeat(np.array(r[c], bool), counts) for c in ("scored", "target")]
                number = r["piece"] if any(r["scored"]) else None  # only pieces with texts to score ask for sums
                for kind, (keys, key) in zip((_WORD, _FIRST, _PAIR), _keys(words, at, counts), strict=True):
                    n, t = (np.bincount(key[m], minlength=len(keys)) for m in marks)
                    ends, rows = range_bounds(keys, _parts(parts)[kind]), []
                    for p in range(len(ends) - 1):
                        s = slice(ends[p], ends[p + 1])
                        if s.start < s.stop:
                            rows.append((kind, p, number, pack_sorted(keys[s]), pack_small(n[s]), pack_small(t[s])))
                    for lo in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64], strict=True), _ASKED, strict=True)], schema=_ASKED)
                trim()

    return run


def _add(table: pa.Table) -> pa.Table:
    """Sums by key over all pieces, sent back to each piece that asks, in the order of its keys."""
    kind, part, piece, packed, n, t = (table.column(c).to_pylist() for c in ("kind", "part", "piece", "keys", "n", "t"))
    keys = [unpack_sorted(b) for b in packed]
    ends = np.cumsum([0, *map(len, keys)])
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([_counts_of(b) for b in x]), len(all_keys)).astype(np.int64) for x in (n, t))
    word = kind[0] == _WORD
    rows = [(kind[0], part[0], None, None, None, len(all_keys), int(n.sum()), int(t.sum()))] if word else []
    for i, p in enumerate(piece):
        if p is not None:
            mine = at[ends[i] : ends[i + 1]]
            rows.append((kind[0], part[0], p, pack_small(n[mine]), pack_small(t[mine]), None, None, None))
    out = pa.Table.from_pylist([dict(zip(_REPLIES.names, r, strict=True)) for r in rows], schema=_REPLIES)
    del keys, all_keys, at, n, t
    trim()
    return out


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each occurrence's key occurs in its own text."""
    _, at, k = np.unique(row * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
    return k[at]


def _scorer(size: int, totals: tuple[int, int], weight: float):
    """Rows of one piece, body and sums, to losses of its texts. A text that a model has counted is left out of it."""

    def run(table: pa.Table) -> pa.Table:
        sums, body = {_WORD: [], _FIRST: [], _PAIR: []}, None
        for r in table.to_pylist():
            if r["kind"] == _BODY:
                body = r
            else:
                sums[r["kind"]].append((r["part"], _counts_of(r["n"]), _counts_of(r["t"])))
        words, at, counts = unpack_sorted(body["words"]), _widen(body["at"]), _counts_of(body["counts"])
        keys = [k for _, k in _keys(words, at, counts)]
        row = np.repeat(np.arange(len(counts)), counts)
        own, losses = [_own(row, k) for k in keys], []
        for which, total, counted in ((2, totals[1], body["target"]), (1, totals[0], body["scored"])):
            mine = np.array(counted, np.int64)
            word, seen, pair = (np.concatenate([x[which] for x in sorted(sums[s], key=lambda x: x[0])] or [np.zeros(0, np.int64)])[k] - mine[row] * o for s, k, o in zip((_WORD, _FIRST, _PAIR), keys, own, strict=True))
            one = (word + 1) / ((total - mine * counts)[row] + size)
            # The bigram estimate mixed with the add-one unigram one, which alone serves after unseen words.
            loss = -np.log2(np.where(seen > 0, weight * (pair / np.maximum(seen, 1)) + (1 - weight) * one, one))
            with np.errstate(invalid="ignore"):
                losses.append(np.bincount(row, loss, len(counts)) / counts)
        none = counts == 0
        out = pa.table({"doc_id": pa.array(body["ids"], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), **{c: pa.array(x, pa.float64(), mask=none) for c, x in zip(("target_loss", "background_loss", "score"), (*losses, losses[0] - losses[1]), strict=True)}})
        trim()
        return out.filter(pa.array(body["scored"], pa.bool_()))

    return run


def marked_difference(rows: DataFrame, size: int, shape: Shape = Shape()) -> DataFrame:
    """Losses of the rows with `scored`, which make the background model, while those with `target` make the target model.

    Rows are doc_id, text, scored and target; size is about the bytes of their texts. A row is scored by models of all other
    rows: what it lent to a model is taken off again, so that target rows don't look like the target for being in it. Both
    models share one vocabulary, all distinct words and one unknown, and one smoothing, and their estimates add up to one. The
    background is all rows, not a sample of the target's size, so that its counts cover the corpus. Counts are kept by 64-bit hash of the
    word or pair and grow with the corpus: pieces of the corpus send what they counted to ranges of keys, which add it up
    and send each piece the sums of its own keys. As a piece sends a key once, frequent keys weigh no more than others.
    """
    ship(rows.sparkSession)
    rows = rows.select("doc_id", "text", "scored", "target")
    bodies = save(rows.mapInArrow(_bodies, _BODIES), "lm-pieces")
    asked = bodies.mapInArrow(_asked(parts_for(size, PIECE)), "kind int, part int, piece long, keys binary, n binary, t binary")
    replies = save(asked.groupBy("kind", "part").applyInArrow(_add, "kind int, part int, piece long, n binary, t binary, distinct long, n_words long, t_words long"), "lm-sums")
    distinct, *totals = (x or 0 for x in replies.where("piece is null").agg(F.sum("distinct"), F.sum("n_words"), F.sum("t_words")).first())
    run = _scorer(shape.words or distinct + 1, tuple(totals), shape.weight)
    own = bodies.where(F.exists("scored", lambda x: x)).withColumn("kind", F.lit(_BODY))
    both = own.unionByName(replies.where("piece is not null").select("kind", "part", "piece", "n", "t"), allowMissingColumns=True)
    return both.groupBy("piece").applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss (bits a word) and score, their difference.

    Losses are those of a model of the target texts and of one, of the same vocabulary and smoothing, of all other docs. A low
    score means text more like the target than like the background. Where the target is part of docs, mark its rows and use
    marked_difference, which leaves a row out of the target too. Text without words, null too, has null losses. Null and
    repeated ids are kept as they are; other columns are ignored.
    """
    texts = lambda d, i, scored: d.select(i.cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(scored).alias("scored"), F.lit(not scored).alias("target"))
    size = text_bytes(docs, text_col) + text_bytes(target, text_col)
    return marked_difference(texts(docs, F.col(id_col), True).unionByName(texts(target, F.lit(None), False)), size, shape)
