"""Similarity join of documents by the Jaccard index of their word n-gram sets, with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import LARGE_ROWS, column, forget, mix, new_key, pack_small, pack_sorted, parts_for, range_bounds, save, signed, text_bytes, trim, unpack_small, unpack_sorted, windows, word_chunks
from .components import components

#: Bytes of text that one piece of the documents, and one range of tokens, stand for.
PIECE, RANGE = 4 << 20, 8 << 20
#: Runs in which pieces meet the counts of their tokens, so that a third of them is in shuffle files at a time.
WAVES = 3
#: Greatest count that is told apart from others; tokens beyond it are in the order of their hash.
_MOST_COUNT = 65_535

_PIECES = "piece long, ids array<long>, n array<long>, s1 array<long>, s2 array<long>, rows binary, tokens binary"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def _sets(text: pa.Array, n_words: int, key: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, sizes, two sums, tokens) of runs of rows; the tokens of a row are distinct and ascending."""
    for lo, hi, words, counts in word_chunks(text, lower=True, key=key):
        rows, _, h = windows(words, counts, n_words)
        short = np.flatnonzero((counts > 0) & (counts < n_words))
        if len(short):
            before = np.cumsum(counts) - counts
            whole = np.array([windows(words[before[r] : before[r] + counts[r]], counts[r : r + 1], int(counts[r]))[2][0] for r in short], np.uint64)
            rows, h = np.concatenate((rows, short)), np.concatenate((h, mix(whole + np.uint64(1))))
            order = np.argsort(rows, kind="stable")
            rows, h = rows[order], h[order]
        edge = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
        sizes = np.bincount(rows, minlength=hi - lo)
        sums = []
        for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
            at = np.concatenate(([0], np.cumsum(sizes)))
            sums.append(total[at[1:]] - total[at[:-1]])
        yield lo, hi, sizes, *sums, h


def _pieces(n_words: int, key: int):
    """Pieces of the documents, a row each: every row's id, set size and two sums that identify its set, and the tokens of
    one row (that of the smallest id) for each distinct set of the piece. Rows without an id lend no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            names = column(batch, "doc_id")
            for lo, hi, sizes, s1, s2, h in _sets(column(batch, "text"), n_words, key):
                own = names.slice(lo, hi - lo)
                ids, known = own.fill_null(0).to_numpy(zero_copy_only=False), ~own.is_null().to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, ~known, s2, s1, sizes))
                first = np.ones(hi - lo, bool)
                first[1:] = (sizes[order][1:] != sizes[order][:-1]) | (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
                stay = np.zeros(hi - lo, bool)
                stay[order[first]] = True
                stay &= (sizes > 0) & known
                values = (number, own.to_pylist(), sizes, signed(s1), signed(s2), pack_small(np.flatnonzero(stay)), h[np.repeat(stay, sizes)].tobytes())
                types = (pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["piece", "ids", "n", "s1", "s2", "rows", "tokens"])
                number += 1
        trim()

    return run


def _asked(parts: int):
    """Rows of pieces to counts of their tokens, a row for each range of tokens; a token is one entry however many sets have it."""
    schema = pa.schema([("part", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("k", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, tokens in zip(column(batch, "piece").to_pylist(), column(batch, "tokens"), strict=True):
                keys, k = np.unique(np.frombuffer(tokens.as_py(), "<u8"), return_counts=True)
                ends = range_bounds(keys, parts)
                rows = [(p, piece, pack_sorted(keys[i:j]), pack_small(k[i:j])) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 256], strict=True), schema, strict=True)], schema=schema)
        trim()

    return run


def _add(table: pa.Table) -> pa.Table:
    """Sums of one range's counts over all pieces, sent back to each piece in the order of its tokens."""
    part, piece, packed, k = (table.column(c).to_pylist() for c in ("part", "piece", "keys", "k"))
    keys = [unpack_sorted(b) for b in packed]
    ends = np.cumsum([0, *map(len, keys)])
    at = np.unique(np.concatenate(keys), return_inverse=True)[1]
    del keys, packed
    sums = np.minimum(np.bincount(at, np.concatenate([unpack_small(b) for b in k])), _MOST_COUNT).astype(np.uint16)
    found = [pack_small(sums[at[i:j]]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    del at, sums
    trim()
    return pa.table({"part": pa.array(part, pa.int32()), "piece": pa.array(piece, pa.int64()), "k": pa.array(found, pa.binary())})


def _combined(n: int, percent: int) -> list[int]:
    """Numbers of groups by which a set of n tokens combines frequent tokens.

    Sizes fall into classes between powers of two, each with one number of groups, about as many as a prefix must hold
    combinations. A set takes part in its own class and in that of every larger set that can be similar.
    """
    out = []
    for c in range(n.bit_length() - 1, (n * 100 // percent).bit_length()):
        low, least = 1 << c, -(-percent * (1 << c) // 100)
        out.append(max(1, min(low - least + 1, -(-percent * least // 100) - 1)))
    return sorted(set(out))


def _keys(n: int, often: np.ndarray, tokens: np.ndarray, percent: int, frequent: int) -> np.ndarray:
    """The index keys of a set of n tokens, of which those given occur elsewhere too.

    Of two similar sets each lacks at most n - o tokens of the other, o = percent * n / 100. A prefix of the rarest tokens (ties
    by hash) is long enough if taking n - o tokens away leaves a key of it: a rare token is a key by itself, and so counts for
    one; frequent tokens, dealt to groups, are keys by pairs within a group, so a group of f counts for f - 1. Tokens that occur
    nowhere else come first, count for one each and need no key. Then the set whose prefix ends first shares one of
    its keys with the other.
    """
    need = n + (-percent * n // 100) + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, often))
    often, tokens = often[order], tokens[order]
    rare = int(np.searchsorted(often, frequent, "right")) if percent > 50 else len(tokens)
    out = [mix(tokens[: min(rare, need)] + np.uint64(1))]
    need, tokens = need - rare, tokens[rare:]
    if need > 0:
        for groups in _combined(n, percent):
            group = (mix(tokens ^ np.uint64(groups)) % np.uint64(groups)).astype(np.int64)
            counts = np.ones(len(tokens), bool)
            counts[np.unique(group, return_index=True)[1]] = False
            upto = int(np.searchsorted(np.cumsum(counts), need)) + 1
            by = np.argsort(group[:upto], kind="stable")
            group, dealt = group[:upto][by], tokens[:upto][by]
            for k in range(1, len(dealt)):  # pairs k apart
                same = group[k:] == group[:-k]
                if not same.any():
                    break
                out.append(mix(mix(dealt[:-k][same] + np.uint64(2)) + dealt[k:][same]))
    return np.unique(np.concatenate(out))


def _features(percent: int, frequent: int):
    """Rows of one piece (its tokens, their counts and the ids that stand for a set) to (doc_id, n, tokens, keys) of the sets
    that have keys; tokens are those that occur elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        body, counts, stand = None, [], set()
        for r in table.to_pylist():
            if r["tokens"] is not None:
                body = r
            elif r["k"] is not None:
                counts.append((r["part"], r["k"]))
            else:
                stand.update(r["stand"])
        out = []
        if stand:
            tokens = np.frombuffer(body["tokens"], "<u8")
            at = np.unique(tokens, return_inverse=True)[1]
            often = np.concatenate([unpack_small(k) for _, k in sorted(counts, key=lambda x: x[0])])[at]
            rows = unpack_small(body["rows"])
            ends = np.cumsum([0, *(body["n"][i] for i in rows)])
            for i, lo, hi in zip(rows, ends[:-1], ends[1:], strict=True):
                if body["ids"][i] in stand:
                    more = often[lo:hi] > 1
                    h = tokens[lo:hi][more]
                    keys = _keys(body["n"][i], often[lo:hi][more], h, percent, frequent)
                    if len(keys):
                        out.append((body["ids"][i], body["n"][i], signed(h), signed(keys)))
        result = pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_FEATURES.types)], schema=_FEATURES)
        del out, body
        trim()
        return result

    return run


def _verified(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda x: features.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return joined.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _may_link(percent: int, a: str, b: str):
    """Can two sets of the given sizes (n_) and numbers of tokens that occur elsewhere (c_) be similar?"""
    n_a, n_b, most = F.col(f"n_{a}"), F.col(f"n_{b}"), F.least(f"c_{a}", f"c_{b}")
    return 100 * most >= percent * (n_a + n_b - most)


def _postings(features: DataFrame) -> DataFrame:
    """(key, doc_id, n, c) of the keys of several sets; of keys that the same sets have, one stays."""
    rows = features.select("doc_id", "n", F.size("tokens").alias("c"), F.explode("keys").alias("key"))
    which = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y")).where("k > 1")
    return rows.join(which.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _pivots(postings: DataFrame) -> DataFrame:
    """For each key the set with the smallest share of tokens of its own, which its relatives are likeliest to resemble."""
    own = F.struct(((F.col("n") - F.col("c")) / F.col("n")).alias("o"), "doc_id", "n", "c")
    return postings.groupBy("key").agg(F.min(own).alias("p")).select("key", F.col("p.doc_id").alias("b"), F.col("p.n").alias("n_b"), F.col("p.c").alias("c_b"))


def _compare(percent: int):
    """Links between the sets asked for and those stored in one block, as (set, component of a set it is linked with)."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().to_batches()
        a, b = [], []
        if t:
            t = t[0]
            ids, n, comp, asks = (column(t, x).to_numpy(zero_copy_only=False) for x in ("doc_id", "n", "comp", "asks"))
            lists = column(t, "tokens")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            words, flat = np.unique(flat, return_inverse=True)
            stored, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
            if len(stored) and len(asked):
                spans = [flat[offsets[i] : offsets[i + 1]] for i in stored]
                starts = np.cumsum([0, *map(len, spans)])[:-1]
                held, n_s, comp_s = np.concatenate(spans), n[stored], comp[stored]
                mark = np.zeros(len(words), np.int32)
                for i in asked:
                    mine = flat[offsets[i] : offsets[i + 1]]
                    mark[mine] = 1
                    both = np.add.reduceat(mark[held], starts)
                    mark[mine] = 0
                    linked = (100 * both >= percent * (n[i] + n_s - both)) & (comp_s != comp[i])
                    if linked.any():
                        new = np.unique(comp_s[linked])
                        a += [ids[i]] * len(new)
                        b += new.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_links(features: DataFrame, percent: int, block_tokens: int = 500_000, block_asks: int = 512) -> DataFrame:
    """Links (a, b) between similar sets, enough to connect all that are linked.

    First all sets with one key are compared with one of them. Those found similar are a component from then on, and only
    keys whose sets lie in several components go on. The sets that such keys connect are a family; its largest component
    needs no more comparisons within. Every other set of the family is compared with all of the family, in blocks of
    bounded size, except with its own component. No pair with a common key is left out otherwise.
    """
    postings = save(_postings(features), "postings")
    pivots = _pivots(postings)
    side = postings.select("key", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    pairs = side.join(pivots, "key").where((F.col("a") != F.col("b")) & _may_link(percent, "a", "b")).select("a", "b").distinct()
    first = save(_verified(pairs, features, percent), "links-first")
    comps = save(components(first), "components-first").select(F.col("id").alias("doc_id"), "component_id")
    now = postings.join(comps, "doc_id", "left").select("key", "doc_id", "n", "c", F.coalesce("component_id", "doc_id").alias("comp"))
    open_ = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    live = save(now.join(open_, "key", "left_semi"), "postings-open")
    ties = live.join(_pivots(live), "key").select(F.col("doc_id").alias("a"), "b").distinct()
    families = components(ties).select(F.col("id").alias("doc_id"), F.col("component_id").alias("family"))
    members = save(live.select("doc_id", "comp", "c").distinct().join(families, "doc_id"), "families")
    parts = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("t"))
    sums = parts.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), (F.sum("k") - F.max("k")).alias("asks"), F.sum("t").alias("t"))
    blocks, chunks = F.ceil(F.col("t") / block_tokens), F.ceil(F.col("asks") / block_asks)
    plan = members.join(sums.select("family", "most", blocks.cast("int").alias("blocks"), chunks.cast("int").alias("chunks")), "family")
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stored = plan.select("doc_id", "comp", "family", F.lit(False).alias("asks"), at("blocks", 1).alias("block"), F.explode(upto("chunks")).alias("chunk"))
    asking = plan.where("comp != most").select("doc_id", "comp", "family", F.lit(True).alias("asks"), F.explode(upto("blocks")).alias("block"), at("chunks", 2).alias("chunk"))
    sets = features.select("doc_id", "n", "tokens")
    found = stored.unionByName(asking).join(sets, "doc_id").groupBy("family", "block", "chunk").applyInArrow(_compare(percent), "a long, b long")
    return first.unionByName(save(found.distinct(), "links-found"))


def ngram_jaccard(docs: DataFrame, n_words: int = 5, percent: int = 80, frequent: int = 16, range_bytes: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set) and component_id.

    A document's set has its distinct runs of n_words words, with A-Z in lower case; a shorter text is one run; null, empty
    and blank texts have the empty set, which is linked with nothing. Two documents are linked if their sets' Jaccard index
    is percent / 100 or more. component_id is the smallest doc_id reachable by links. A null id stays alone, with a null
    component_id; rows that repeat an id are taken for one document. Other columns are ignored.

    Words are hashed under a key of this run, shingles are sums of their words' hashes, and sets are compared by these 64 bits.
    Equal sets (by size and two 64-bit sums) are joined first, and one row stands for them. Tokens are counted over all
    documents: pieces send the counts of their own tokens to ranges of tokens and get the sums back, so a token that every
    document has is one entry a piece. A set is indexed by its rarest tokens: those in at most `frequent` sets, whose postings
    so stay short, by themselves, others by pairs; see _keys. (At 50 percent or less, where pairs can't be complete, all go by
    themselves.) Candidates are verified on whole sets.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts_for(text_bytes(d), range_bytes)
    pieces = save(d.mapInArrow(_pieces(n_words, new_key()), _PIECES), "shingle-pieces", LARGE_ROWS)
    sets = save(pieces.select("piece", F.explode(F.arrays_zip("ids", "n", "s1", "s2")).alias("x")).select("piece", F.col("x.ids").alias("doc_id"), "x.n", "x.s1", "x.s2"), "sets")
    least = F.min(F.struct("doc_id", "piece")).alias("x")
    classes = save(sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(least).select("n", "s1", "s2", F.col("x.doc_id").alias("class_id"), "x.piece"), "classes")
    asked = pieces.select("piece", "tokens").mapInArrow(_asked(parts), "part int, piece long, keys binary, k binary")
    counts = save(asked.groupBy("part").applyInArrow(_add, "part int, piece long, k binary"), "token-counts")
    stand = classes.groupBy("piece").agg(F.collect_list("class_id").alias("stand"))
    both = pieces.select("piece", "ids", "n", "rows", "tokens").unionByName(counts, allowMissingColumns=True).unionByName(stand, allowMissingColumns=True)
    tasks = ((pieces.agg(F.max("piece")).first()[0] or 0) >> 24) + 1
    ends = sorted({tasks * w // WAVES << 24 for w in range(WAVES + 1)})
    made = [both.where((F.col("piece") >= lo) & (F.col("piece") < hi)).groupBy("piece").applyInArrow(_features(percent, frequent), "doc_id long, n long, tokens array<long>, keys array<long>") for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    features = reduce(DataFrame.unionByName, [save(m, "features") for m in made])
    forget(pieces, counts)
    comps = components(similar_links(features, percent)).withColumnRenamed("id", "class_id")
    out = sets.join(classes.drop("piece"), ["n", "s1", "s2"], "left").join(comps, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "class_id", "doc_id")).alias("component_id"))
