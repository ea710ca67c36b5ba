"""Packing of tokenised documents into sequences: bin completion with branch and bound over the histogram of lengths."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.session import ship

from .bpe import byte_symbols
from .common import column, parts_for, save, trim

#: A run of equal sequences: how many, and how often each length is in one of them.
Run = tuple[int, dict[int, int]]


# --- tokens ----------------------------------------------------------------------------------


class ByteTokenizer:
    """Ids of a byte-level BPE file of the `tokenizers` library, by tiktoken with the file's own vocabulary.

    The two give the same ids (the tests compare every code point); texts that tiktoken's pattern can't run through, with
    hundreds of thousands of blanks in a row, go to the library itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        self.pattern, self._ready = pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _tools(self):
        if self._ready is None:
            import tiktoken

            spec = json.loads(self.json)
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            byte = {c: b for b, c in enumerate(byte_symbols())}
            ranks = {bytes([byte[c] for c in t]): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self._ready = tiktoken.Encoding("sieveline", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        return self._ready

    @cache  # noqa: B019  one for each worker
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self._tools().encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self._library().encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and end_id, cut into pieces; ids as little-endian 32-bit numbers.

    Documents up to `capacity` are one piece. Longer ones are cut so that every piece but the first is full. Null and empty
    texts are end_id alone; rows that repeat an id, or have none, are documents of their own; other columns are ignored.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ByteTokenizer(path, pattern or public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            doc, text = column(batch, "doc_id"), column(batch, "text")
            rows: list[int] = []
            parts: list[tuple[int, int, int, bytes]] = []
            for i in range(len(text)):
                ids = np.append(t.encode(text[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append(i)
                    parts.append((k, lo, hi - lo, ids[lo:hi].tobytes()))
            piece, start, length, ids = zip(*parts, strict=True) if parts else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names)
        trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary")


# --- the search ------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: counts[l] pieces of each length l up to the capacity, len(counts) - 1.

    For a threshold t, pieces above capacity - t are alone among those of at least t; those above half need one each; what
    the rest of at least t exceeds the space beside them adds to it.
    """
    c = len(counts) - 1
    length = np.arange(c + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * length)
    best = -(-int(s[-1]) // c)
    for t in range(1, c // 2 + 1):
        alone, large = int(n[c] - n[c - t]), int(n[c - t] - n[c // 2])
        space = large * c - int(s[c - t] - s[c // 2])
        rest = int(s[c // 2] - s[t - 1])
        best = max(best, alone + large + max(0, -(-(rest - space) // c)))
    return best


def _dominated(filling: Sequence[int], slack: int, free: np.ndarray) -> bool:
    """Could some members make way for one longer piece (free: lengths of which one is left)? Then the filling with it is no worse."""
    sums = {0: 0}
    for x in filling[:6]:
        sums |= {s + x: k + 1 for s, k in sums.items() if s + x not in sums}
    return any(k and free[s + (k == 1) : s + slack + 1].any() for s, k in sums.items())


def fillings(counts: np.ndarray, space: int, most: int = 6, steps: int = 60) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated (slack, lengths) that fill `space` from the pieces left, least slack first, then fewest pieces.

    One piece that fills it exactly dominates all others. Else the enumeration goes by longest piece, each filling is maximal,
    and those in which a longer piece could take the place of members are left out. It ends after `steps` fillings, so
    that a sequence costs a bounded time; lengths in use are counted down as pieces are placed.
    """
    if space < len(counts) and counts[space]:
        return [(0, (space,))]
    free = counts[: space + 1] > 0
    have = np.flatnonzero(free)
    if not len(have):
        return [(space, ())]
    found: dict[tuple[int, ...], int] = {}
    pairs = have[(counts[space - have] > (have * 2 == space)) & (have * 2 >= space)]
    for a in pairs[::-1][:most].tolist():  # exact pairs, by the longest
        found[a, space - a] = 0
    tried = 0

    def longest(upto: int, used: dict[int, int]) -> int:
        i = int(np.searchsorted(have, upto, "right")) - 1
        while i >= 0 and counts[have[i]] <= used.get(int(have[i]), 0):
            i -= 1
        return int(have[i]) if i >= 0 else 0

    def go(room: int, upto: int, chosen: tuple[int, ...], used: dict[int, int], branch: int) -> None:
        nonlocal tried
        x = longest(min(room, upto), used)
        if not x:
            tried += 1
            if chosen not in found and not _dominated(chosen, room, free):
                found[chosen] = room
        for _ in range(branch):
            if not x or tried >= steps:
                break
            k = min(room // x, int(counts[x]) - used.get(x, 0)) if x * 8 <= room else 1  # many short pieces at once
            go(room - k * x, x, (*chosen, *[x] * k), used | {x: used.get(x, 0) + k}, max(1, branch - 1))
            x = longest(x - 1, used)

    if len(found) < most:
        go(space, space, (), {}, 4)
    return sorted(((s, c) for c, s in found.items()), key=lambda f: (f[0], len(f[1])))[:most] or [(space, ())]


def _run(counts: np.ndarray, first: int, filling: Sequence[int]) -> Run:
    """The sequence made as often as its pieces allow."""
    uses: dict[int, int] = {}
    for x in (first, *filling):
        uses[x] = uses.get(x, 0) + 1
    return min(int(counts[x]) // k for x, k in uses.items()), uses


def _place(counts: np.ndarray, run: Run, sign: int = -1) -> None:
    for x, k in run[1].items():
        counts[x] += sign * run[0] * k


def best_fit(counts: np.ndarray) -> list[Run]:
    """The longest piece left, then again and again the longest that fits: the first incumbent."""
    left, out = counts.copy(), []
    for first in range(len(counts) - 1, 0, -1):
        while left[first]:
            uses = {first: 1}
            space = len(counts) - 1 - first
            while space:
                have = np.flatnonzero(left[1 : space + 1])[::-1] + 1
                x = next((int(x) for x in have if left[x] > uses.get(int(x), 0)), 0)
                if not x:
                    break
                k = min(space // x, int(left[x]) - uses.get(x, 0))
                uses[x] = uses.get(x, 0) + k
                space -= k * x
            run = min(int(left[x]) // k for x, k in uses.items()), uses
            _place(left, run)
            out.append(run)
    return out


def complete(counts: np.ndarray, nodes: int = 4000) -> list[Run]:
    """Runs of sequences that hold counts[l] pieces of each length l, in as few sequences as the search finds.

    Depth first: the longest piece left is completed by each of its fillings in turn, and that sequence is repeated as
    often as the pieces allow, so that the depth depends on the number of lengths rather than of pieces. The best packing so far is the
    incumbent, at first that of best_fit: a branch ends where the space it has wasted leaves no chance of one as good. The search
    ends when it has met the lower bound (then none is better) or after `nodes` steps backwards.
    """
    c, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    best, bound = best_fit(counts), lower_bound(counts)
    fewest = sum(m for m, _ in best) + 1  # one as good as the first incumbent takes its place
    left, path, waste, back = counts.copy(), [], 0, 0
    stack: list[list] = []
    while fewest > bound:
        may_waste = (fewest - 1) * c - total  # in a packing that is better
        first = int(np.flatnonzero(left)[-1]) if left.any() else 0
        if first == 0:
            best, fewest = list(path), sum(m for m, _ in path)
        elif waste <= may_waste:
            left[first] -= 1
            found = fillings(left, c - first)
            left[first] += 1
            options = [_run(left, first, f) for _, f in found]
            stack.append([iter(options), None])
        while stack and fewest > bound:
            options, last = stack[-1]
            if last is not None:
                _place(left, last, 1)
                path.pop()
                waste -= last[0] * (c - sum(x * k for x, k in last[1].items()))
                stack[-1][1] = None
                back += 1
            run = next(options, None) if back <= nodes else None
            if run is not None:
                _place(left, run)
                path.append(run)
                waste += run[0] * (c - sum(x * k for x, k in run[1].items()))
                stack[-1][1] = run
                break
            stack.pop()
        if not stack:
            break
    return best


# --- the assignment ----------------------------------------------------------------------------


def _ranked(pieces: DataFrame, part_rows: int) -> DataFrame:
    """Number the pieces of each length from 0, in two steps: hash ranges, then inside each range."""
    n = parts_for(pieces.count(), part_rows, 8)
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    dealt = pieces.withColumn("sieveline_part", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(n)).cast("int"))
    sums = dealt.groupBy("length", "sieveline_part").agg(F.count(F.lit(1)).alias("sieveline_n"))
    earlier = sums.select("length", "sieveline_part", (F.sum("sieveline_n").over(Window.partitionBy("length").orderBy("sieveline_part")) - F.col("sieveline_n")).alias("sieveline_before"))
    inside = F.row_number().over(Window.partitionBy("length", "sieveline_part").orderBy("doc_id", "piece", *others)) - 1
    return dealt.withColumn("sieveline_rank", inside).join(earlier, ["length", "sieveline_part"]).withColumn("rank", F.col("sieveline_before") + F.col("sieveline_rank")).drop("sieveline_part", "sieveline_rank", "sieveline_before")


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = 4000, part_rows: int = 200_000) -> DataFrame:
    """pieces (doc_id, piece, length, any other columns) with sequence_id and offset, gapless from 0 in each sequence.

    No sequence is longer than `capacity`, which no piece may exceed. The driver gets the histogram of lengths, `capacity` rows
    at most, and plans runs of equal sequences; the plan's size depends on the capacity only. Pieces of one length are
    alike, so each takes the place of its rank among them, found by binary search in the plan: tasks need no other piece, and a
    length that a third of all pieces have is ranked in as many tasks as it fills. Pieces should be a stored table.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        if not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of length {r['length']}")
        counts[r["length"]] = r["n"]
    plan, upto, at = [], np.zeros(capacity + 1, np.int64), 0
    for many, uses in complete(counts, nodes):
        offset = 0
        for x in sorted(uses, reverse=True):
            plan.append((x, upto[x], at, uses[x], offset))
            upto[x] += many * uses[x]
            offset += x * uses[x]
        at += many
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table, np.searchsorted(table[:, 0], np.arange(capacity + 2))))
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, begins = shared.value
        for batch in batches:
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for x, lo, hi in zip(*_groups(length[order]), strict=True):
                of = order[lo:hi]
                row[of] = begins[x] + np.searchsorted(plan[begins[x] : begins[x + 1], 1], rank[of], "right") - 1
            _, start, at, uses, offset = plan[row].T
            sequence, slot = at + (rank - start) // uses, (rank - start) % uses
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names[:-2]), pa.array(sequence), pa.array(offset + slot * length)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return _ranked(pieces, part_rows).select(*[f"`{c}`" for c in pieces.columns], "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and where each begins and ends."""
    values, lo = np.unique(x, return_index=True)
    return values, lo, np.append(lo[1:], len(x))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, **kw) -> DataFrame:
    """Packed pieces of documents with their ids: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(save(token_pieces(docs, path, capacity, **kw), "pack-pieces"), capacity)


def pack_digest(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """pack_documents with a checksum in place of the ids, which are not stored then."""
    pieces = token_pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(save(pieces, "pack-pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
