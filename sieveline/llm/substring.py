"""Substring dedup over a log-structured index of window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.session import ship

from .common import block_of, block_of_np, column, from_sortable, new_key, pack_small, pack_sorted, parts_for, range_bounds, save, text_buffers, text_bytes, to_sortable, trim, unpack_small, unpack_sorted, windows, word_chunks

#: What a row of the exchange holds: a sorted run of one piece of a batch, rows found to be repeats, or a compacted run.
_RUN, _HITS, _OLD = 0, 1, 2
_ROWS = "bucket int, kind int, ids binary, hashes binary, owners binary, checks binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()), ("owners", pa.binary()), ("checks", pa.binary())])


def _check(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Second hashes of windows, from the words' second hashes."""
    return (windows(words, counts, n, 2)[2] >> np.uint64(32)).astype(np.uint32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)


def _hit_rows(ids: np.ndarray, hashes: np.ndarray, n: int) -> list[tuple]:
    """Repeats (id, hash) as rows by block of documents."""
    block = block_of_np(ids, n)
    order = np.lexsort((hashes, ids, block))
    block, ids, hashes = block[order], ids[order], hashes[order]
    out = []
    for lo, hi in zip(cuts := np.flatnonzero(np.diff(block, prepend=-1)), [*cuts[1:], len(block)], strict=True):
        names, k = np.unique(ids[lo:hi], return_counts=True)
        out.append((int(block[lo]), _HITS, pack_sorted(to_sortable(names)), hashes[lo:hi].astype("<u8").tobytes(), pack_small(k), b""))
    return out


def sorted_runs(docs: DataFrame, n_words: int, buckets: int, blocks: int, key: int) -> DataFrame:
    """Level-0 runs: each piece of docs (doc_id, text) as ascending distinct window hashes, by range of hash.

    Of the windows of one piece with one hash only the one of the smallest id goes into the run. The others, whose check
    hash agrees, are repeats already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, (words, second), counts in word_chunks(column(batch, "text"), families=2, key=key):
                names, rank = np.unique(all_ids[lo:hi], return_inverse=True)
                rows, _, h = windows(words, counts, n_words)
                if not len(h):
                    continue
                owner, check = rank[rows].astype(np.uint32), _check(second, counts, n_words)
                order = np.argsort(h, kind="stable")
                h, owner, check = h[order], owner[order], check[order]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                size = np.diff(np.append(start, len(h)))
                least = np.minimum.reduceat(owner, start)
                mine = owner == np.repeat(least, size)
                # One of the smallest owner's windows of each hash stands for it; any serves, as their check must agree.
                at = np.flatnonzero(mine)
                first = at[np.concatenate(([True], h[at][1:] != h[at][:-1]))]
                same = check == np.repeat(check[first], size)
                hit = ~mine & same
                odd = np.flatnonzero(~same)  # another window with this hash: it goes into a run of its own
                keep = np.concatenate((first, odd)) if len(odd) else first
                if len(odd):
                    keep = keep[np.argsort(h[keep], kind="stable")]
                out = _hit_rows(names[owner[hit]], h[hit], blocks) if hit.any() else []
                kh, ko, kc = h[keep], owner[keep], check[keep]
                cut = range_bounds(kh, buckets)
                for b in np.flatnonzero(cut[1:] > cut[:-1]):
                    i, j = cut[b], cut[b + 1]
                    used, own = np.unique(ko[i:j], return_inverse=True)
                    out.append((int(b), _RUN, pack_sorted(to_sortable(names[used])), pack_sorted(kh[i:j]), pack_small(own), kc[i:j].tobytes()))
                yield _rows(out)
        trim()

    return docs.mapInArrow(run, _ROWS)


def _ranged(history: DataFrame, buckets: int) -> DataFrame:
    """The compacted runs of an index cut at the bounds of `buckets` ranges, whatever ranges they were written in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, ids in zip(*(column(batch, n).to_pylist() for n in ("hashes", "checks", "ids")), strict=True):
                h, c = unpack_sorted(h), np.frombuffer(c, np.uint32)
                ends = range_bounds(h, buckets)
                yield _rows([(int(b), _OLD, ids, pack_sorted(h[ends[b] : ends[b + 1]]), b"", c[ends[b] : ends[b + 1]].tobytes()) for b in np.flatnonzero(ends[1:] > ends[:-1])])
        trim()

    return history.mapInArrow(cut, _ROWS)


def _tag(key: int, level: int) -> bytes:
    """What the rows of one run have for ids: the key of its hashes, its level, and a number of its own."""
    return key.to_bytes(8, "little") + bytes([level]) + new_key().to_bytes(8, "little")


def merge_runs(runs: DataFrame, blocks: int, keep_index: bool, key: int, only_new: bool = False) -> DataFrame:
    """Merge-join the runs of each hash range: repeats (by block of documents), and one compacted run if wanted, of all windows or
    only of those that no run of the history has.

    A window is a repeat if a compacted run of earlier batches holds its hash and check hash, or another run does for a
    smaller id.
    """

    tag = _tag(key, 0)

    def merge(of: tuple, table: pa.Table) -> pa.Table:
        hs, ids, cs, out = [], [], [], []
        for batch in table.to_batches():
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, kind, names, h, o, c = row
                if kind == _HITS:
                    out.append(row)
                    continue
                h = unpack_sorted(h)
                hs.append(h)
                cs.append(np.frombuffer(c, np.uint32))
                ids.append(from_sortable(unpack_sorted(names))[unpack_small(o)] if kind == _RUN else np.full(len(h), np.iinfo(np.int64).min))
        if hs:
            h, owner, check = map(np.concatenate, (hs, ids, cs))
            hs.clear(), ids.clear(), cs.clear()
            order = np.argsort(h, kind="stable")
            h, owner, check = h[order], owner[order], check[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            differs = ~new
            differs[1:] &= check[1:] != check[:-1]
            if differs.any():  # windows that share a hash but not a check hash: order these groups by check
                group = np.cumsum(new)
                at = np.flatnonzero(np.isin(group, group[differs]))
                sub = at[np.lexsort((check[at], h[at]))]
                h[at], owner[at], check[at] = h[sub], owner[sub], check[sub]
                new[1:] |= check[1:] != check[:-1]
            start = np.flatnonzero(new)
            least = np.minimum.reduceat(owner, start)
            hit = owner > np.repeat(least, np.diff(np.append(start, len(h))))
            if hit.any():
                out += _hit_rows(owner[hit], h[hit], blocks)
            if keep_index:
                kept = start[least > np.iinfo(np.int64).min] if only_new else start
                if len(kept):
                    out.append((int(of[0].as_py()), _OLD, tag, pack_sorted(h[kept]), b"", check[kept].tobytes()))
            del h, owner, check, order, new, start, least, hit
            trim()
        return pa.Table.from_batches([_rows(out)])

    return runs.groupBy("bucket").applyInArrow(merge, _ROWS)


def _levelled(index: DataFrame, key: int, fanout: int) -> DataFrame:
    """The index with every level of `fanout` runs merged into one run of the next; runs never hold a window of another."""

    def merged(tag: bytes):
        def merge(of: tuple, table: pa.Table) -> pa.Table:
            h = np.concatenate([unpack_sorted(x) for x in table.column("hashes").to_pylist()])
            check = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("checks").to_pylist()])
            order = np.lexsort((check, h))
            return pa.Table.from_batches([_rows([(int(of[0].as_py()), _OLD, tag, pack_sorted(h[order]), b"", check[order].tobytes())])])

        return merge

    while True:
        runs = index.groupBy(F.substring("ids", 9, 9).alias("tag")).agg(F.sum(F.octet_length("checks")).alias("n")).collect()  # a row a run
        levels = [bytes(r["tag"])[0] for r in runs]
        full = min((x for x in levels if levels.count(x) >= fanout), default=None)
        if full is None:
            return index
        mine = F.substring("ids", 9, 1) == F.lit(bytearray([full]))
        buckets = parts_for(8 * sum(r["n"] for r, x in zip(runs, levels, strict=True) if x == full), 8 << 20)
        one = _ranged(index.where(mine), buckets).groupBy("bucket").applyInArrow(merged(_tag(key, full + 1)), _ROWS)
        index = index.where(~mine).unionByName(save(one, "substring-level"))


def _cut(docs: DataFrame, hits: DataFrame, n_words: int, blocks: int, key: int) -> DataFrame:
    """Documents without the words that their repeats cover."""

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids = np.concatenate([np.repeat(from_sortable(unpack_sorted(i)), unpack_small(k)) for i, k in zip(found.column("ids").to_pylist(), found.column("owners").to_pylist(), strict=True)] or [np.zeros(0, np.int64)])
        hashes = np.concatenate([np.frombuffer(x, "<u8") for x in found.column("hashes").to_pylist()] or [np.zeros(0, np.uint64)])
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else ids
        of = {int(ids[i]): hashes[i:j] for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=False)}
        out = []
        for batch in texts.to_batches():
            names = column(batch, "doc_id").to_pylist()
            text = column(batch, "text")
            data, offsets = text_buffers(text)
            for lo, hi, words, counts in word_chunks(text, size=1 << 20, key=key):
                rows, start, h = windows(words, counts, n_words)
                edge = np.searchsorted(rows, np.arange(hi - lo + 1))
                before = np.cumsum(counts) - counts
                kept, removed = [], []
                for r in range(hi - lo):
                    own = data[offsets[lo + r] : offsets[lo + r + 1]].tobytes().split()
                    gone = 0
                    if (mine := of.get(names[lo + r])) is not None:
                        at = start[edge[r] : edge[r + 1]][np.isin(h[edge[r] : edge[r + 1]], mine)] - before[r]
                        covered = np.zeros(len(own) + 1, np.int64)
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + n_words, -1)
                        covered = np.cumsum(covered[:-1]) > 0
                        gone = int(covered.sum())
                        own = [w for w, c in zip(own, covered, strict=True) if not c]
                    kept.append(b" ".join(own).decode())
                    removed.append(gone)
                out.append(pa.RecordBatch.from_arrays([pa.array(names[lo:hi], pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=_CUT))
        trim()
        return pa.Table.from_batches(out, _CUT)

    spread = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")  # rows without an id have no repeats
    left = docs.withColumn("block", F.when(F.col("doc_id").isNull(), spread).otherwise(block_of(F.col("doc_id"), blocks))).groupBy("block")
    return left.cogroup(hits.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def substring_dedup(docs: DataFrame, n_words: int = 13, history: DataFrame | None = None, keep_index: bool = False, buckets: int | None = None, fanout: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Remove words that lie in a window of n_words words already seen in the index or in a document of smaller id.

    Returns one row per input row (doc_id, n_words, n_removed, kept: the kept words joined by one space) and, if wanted, the
    compacted index: with `history`, the index of earlier batches, every window there counts as seen. Batches of documents
    with ascending ids, each with the index of those before, remove just what one batch of all of them removes. With a fanout
    of 1 each batch writes the whole index anew; otherwise it adds a run of its new windows, and `fanout` runs of one level are merged
    into one of the next, so that a window is written once a level.

    Words are stretches without white space, unchanged. Null and empty texts have no words; shorter texts have no window.
    Rows with a null id neither lose words nor make others lose any. Rows that repeat an id are one document: they don't make
    each other lose words. Windows are equal if two hashes, of 64 and 32 bits, agree: the first places them in the sorted
    runs, the second verifies; they start from independent hashes of the words themselves, under a key that is drawn for a new
    index and kept in it. Batches may have any sizes: an index is cut into the hash ranges of the batch that reads it. Other
    columns are ignored.

    Each piece of the input becomes sorted runs, one for each range of hashes, in which every hash occurs once; so a passage
    in many documents sends one entry for each piece. Repeats go to the block of their document, where texts are read again.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ship(d.sparkSession)
    size = text_bytes(d)
    blocks = parts_for(size, 8 << 20)
    known = None if history is None else history.agg(F.first("ids").alias("key"), F.sum(F.octet_length("checks")).alias("n")).first()
    key = int.from_bytes(known["key"][:8], "little") if known and known["key"] else new_key()
    buckets = buckets or parts_for(size + 8 * (known and known["n"] or 0), 8 << 20)
    runs = sorted_runs(d.where("doc_id is not null"), n_words, buckets, blocks, key)
    if history is not None:
        runs = runs.unionByName(_ranged(history, buckets))
    merged = save(merge_runs(runs, blocks, keep_index, key, fanout > 1), "substring-merged")
    hits = merged.where(f"kind = {_HITS}").select(F.col("bucket").alias("block"), "ids", "hashes", "owners")
    index = merged.where(f"kind = {_OLD}") if keep_index else None
    if index is not None and fanout > 1:
        index = _levelled(index if history is None else history.unionByName(index), key, fanout)
    return _cut(d, hits, n_words, blocks, key), index


def substring_digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the kept words."""
    kept, _ = substring_dedup(docs, **kw)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
