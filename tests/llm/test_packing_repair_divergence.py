"""Packing, conversation repair and divergence of sources against brute force, on nulls, ties, repeated rows, empty tables and
columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import conversations, divergence, packing
from sieveline.llm.queries import tokenizer_path

CLASH = ["rank", "length", "piece", "start", "row", "n", "docs", "shard", "terms", "total", "none", "kind", "at", "copy", "gone", "signature", "how", "part", "value", "item", "sieveline_part"]


# --- packing -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_equal_the_library(tokenizer):
    import public_tokenizers

    own = packing.ByteTokenizer(tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} {c}1{c}. {c}{c}'s" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    texts += ["", " ", "<|endoftext|>x<|endof <|endoftext|>", "it's 'S'LL", "\n" * 20, " " * 600_000 + "x", "a" * 50_000]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == e.ids


def fewest(lengths, capacity):
    """Optimal number of sequences, by trying every place for each piece."""
    lengths = sorted(lengths, reverse=True)

    @cache
    def fits(i, spaces):
        if i == len(lengths):
            return True
        return any(fits(i + 1, tuple(sorted((*spaces[:k], s - lengths[i], *spaces[k + 1 :])))) for k, s in enumerate(spaces) if s >= lengths[i])

    return next(n for n in range(len(lengths) + 1) if fits(0, (capacity,) * n))


def test_search_finds_the_fewest():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 5, capacity // 2 + 1) for _ in range(rng.randint(0, 10))]
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
        found, placed = packing.complete(counts), Counter()
        for many, uses in found:
            assert sum(x * k for x, k in uses.items()) <= capacity
            placed.update({x: many * k for x, k in uses.items()})
        assert placed == Counter(lengths)
        best = fewest(lengths, capacity)
        assert packing.lower_bound(counts) <= best == sum(m for m, _ in found)


def test_search_by_runs():
    counts = np.zeros(2049, np.int64)
    counts[[700, 683, 1200, 64, 1]] = [3 * 10**9, 10**9, 10**9, 7, 5 * 10**9]
    found = packing.complete(counts, 200)
    assert len(found) < 100 and sum(m for m, _ in found) < 1.02 * packing.lower_bound(counts) + 10**9
    assert sum(m * uses.get(1, 0) for m, uses in found) == 5 * 10**9


def test_fillings_are_undominated():
    counts = np.zeros(21, np.int64)
    counts[[3, 4, 7, 9]] = [2, 1, 1, 1]
    assert packing.fillings(counts, 7) == [(0, (7,))]  # the exact piece dominates 3 + 4 and 3 + 3
    assert (0, (7, 3)) in packing.fillings(counts, 10) and all(set(f) != {3, 4} for _, f in packing.fillings(counts, 10))
    assert packing.fillings(counts, 2) == [(2, ())]


@pytest.fixture(scope="module")
def texts(spark):
    words = " ".join(f"w{i} é{i % 7}" for i in range(900))
    rows = [(1, "a b"), (2, None), (3, ""), (4, words), (4, words), (None, "x y z"), (5, words[:3000]), (6, " \t "), (7, "<|endoftext|>")] + [(100 + i, "") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


def test_pieces_and_places(texts, tokenizer):
    out = packing.pack_digest(texts, tokenizer_path("byte_bpe_50k.json"), 256).collect()
    want = Counter()
    for r in texts.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        lo, hi = 0, (len(ids) - 1) % 256 + 1
        for k in range(len(ids)):
            want[r.doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lo, hi = hi, hi + 256
            if lo >= len(ids):
                break
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    counts = np.bincount([r.length for r in out], minlength=257)
    assert len(by) == packing.lower_bound(counts)


def test_packed_ids(texts):
    out = packing.pack_documents(texts.where("doc_id <= 5"), tokenizer_path("byte_bpe_50k.json"), 128)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert all(len(r.ids) == 4 * r.length for r in out.collect())
    assert packing.pack_digest(texts.where("false"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_ranks_in_ranges(spark):
    """A length that most pieces have is ranked in many tasks, without gaps."""
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 5).otherwise(1).cast("long").alias("length"))
    out = packing.pack(pieces, 16, part_rows=200).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("m"), F.max(F.col("offset") + F.col("length")).alias("end"))
    rows = out.collect()
    assert all(r.n == r.end <= 16 and r.k == r.m for r in rows) and len(rows) == -(-(1667 * 5 + 3333) // 16)


# --- conversations -----------------------------------------------------------------------------


def cheapest(signature):
    """All edits with at most two insertions in a place, the cheapest and then ASCII-least ones."""
    best = None
    moves = {"u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}, "s": {"": "s"}}
    turn = {"": "u", "s": "u", "a": "u", "u": "a"}
    for inserts in product(range(3), repeat=len(signature) + 1):
        for edits in product("DKR", repeat=len(signature)):
            state, cost, audit = "", 0, ""
            for symbol, edit, n in zip([*signature, None], [*edits, None], inserts, strict=True):
                for _ in range(n):
                    state, cost, audit = turn[state], cost + 2, audit + "I"
                if symbol is None:
                    break
                audit += edit
                if edit == "D":
                    cost += 3
                    continue
                if symbol == "-":
                    break
                new = moves.get(symbol.lower(), {}).get(state) if edit == "K" else turn[state]
                if new is None:
                    break
                state, cost = new, cost + 2 * (edit == "R") + symbol.isupper()
            else:
                raise AssertionError
            if symbol is None and state in ("", "a"):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_trie_against_all_edits():
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(0, 4))) for _ in range(160)})
    trie = conversations.RepairTrie()
    for s in signatures:
        assert trie.answer(s) == cheapest(s), s


def test_trie_shares_layers_and_goes_far():
    trie, alone = conversations.RepairTrie(), conversations.RepairTrie
    rng = random.Random(2)
    long = "".join(rng.choice("suao-UA") for _ in range(4000))
    family = sorted([long, long[:3000], *(long[:n] + "u" for n in (0, 1, 500, 2999, 3999))])
    assert [trie.answer(s) for s in family] == [alone().answer(s) for s in family]
    assert len(trie.layers) == len(family[-1]) + 1
    cost, audit = alone().answer("ua" * 20_000)
    assert (cost, audit) == (0, "K" * 40_000)


def messy(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Hello there.", "No end", " \t", "", None, "Why?", "Why?  ", "é!", "a.b"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    rows += [(77, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)] + [rows[3], rows[3]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def repaired_by_hand(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = []
    for conv, own in by.items():
        kept = []
        for turn, role, text in own:
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if how == 1:
                text = ""
            elif how == 2:
                text = re.sub("[.!?]", "", text)
            elif how == 4:
                role = "user"
            kept += [((turn is not None, turn or 0), role, text, c) for c in range({0: 0, 3: 2}.get(how, 1))]
        kept.sort()
        seen, faults, signature = set(), Counter(), ""
        for _, role, text, _ in kept:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [t[1] for t, *_ in kept if t[0]]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = conversations.RepairTrie().answer(signature)
        text, rest, last = [], list(kept), "a"
        for e in audit:
            role, body = ("", "") if e == "I" else rest.pop(0)[1:3]
            if e == "D":
                continue
            if e != "K":
                role = "user" if last != "u" else "assistant"
            last = role[:1]
            text.append(f"{role}:{body}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return Counter(out)


def test_repair(spark):
    df = messy(spark)
    clash = df.withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = repaired_by_hand(map(tuple, df.collect()))
    for size in (16 << 20, 1 << 12):
        assert Counter(map(tuple, conversations.repair_digest(clash, size).select(names).collect())) == want
    rows = conversations.repair_conversations(clash).where("conv_id = 77").orderBy("at").collect()
    assert [r.at for r in rows] == list(range(len(rows))) and {r.edit for r in rows} <= {"K", "R", "I"}
    assert conversations.repair_digest(clash.where("false")).count() == 0


def test_repair_in_small_batches(spark):
    """Conversations that go on over many Arrow batches."""
    df, key = messy(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        assert sum(Counter(map(tuple, conversations.repair_digest(df).collect())).values()) == 62
        got = Counter(map(tuple, conversations.repair_digest(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()))
    finally:
        spark.conf.set(key, before)
    assert got == repaired_by_hand(map(tuple, df.collect()))


# --- divergence ----------------------------------------------------------------------------------


def diverged(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = Counter(term.findall((text or "").translate(lower)))
        groups[lang or "", source or ""] += found
        docs[lang or ""].update(found.keys())
    out = set()
    for (lang, source), own in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        others = {s: g for (k, s), g in groups.items() if k == lang}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(own), share(sum(others.values(), Counter()))
        pairs = sorted(((-sum(abs(p[t] - x[t]) for t in kept), s.encode()) for s, x in ((s, share(g)) for s, g in others.items() if s != source)))
        terms = sorted((-(p[t] - q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t])[:top]
        for part, ranked in (("pair", pairs), ("term", terms)):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def test_divergence(spark, monkeypatch):
    rng = random.Random(4)
    words = ["The", "the", "été", "x1y", "don't", "Straße", "日本", "zz", "q", "ÀB", "_a_"]
    rows = [(i, " ".join(rng.choice(words[: 4 + k % 8]) for _ in range(rng.randint(0, 30))), ["en", "de", None, ""][rng.randint(0, 3)], ["a", "b", None, "é", "Z"][k]) for i in range(300) for k in [rng.randint(0, 4)]]
    rows += [(1, None, "en", "empty"), (2, "123 !", "xx", "a"), (3, "", "xx", "b"), (None, " ".join(words) * 3000, "de", "long"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    for least, top, size in ((3, 5, 16 << 20), (30, 50, 1 << 12), (1000, 5, 16 << 20)):
        out = divergence.source_divergence(df, least, top, shard_bytes=size)
        assert {tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()} == diverged(rows, least, top)
        assert out.count() == len(diverged(rows, least, top))
    assert divergence.source_divergence(df.where("false")).count() == 0


def test_partial_counts_add_up(spark):
    df = spark.createDataFrame([(f"a b c{chr(97 + i % 20)} a", "en", f"s{i % 3}") for i in range(200)], "text string, lang string, source string")
    sums = divergence.term_counts(df, most=5).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("d"))
    got = {r.term: (r.n, r.d) for r in sums.collect()}
    assert got["a"] == (400, 200) and got["b"] == (200, 200) and got["ca"] == (10, 10)
