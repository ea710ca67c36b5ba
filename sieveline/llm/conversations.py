"""Repair of damaged conversations: signatures in a prefix trie, one layer of dynamic programming for each shared prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.session import ship

from .common import SPACE, column, parts_for, save, text_bytes, trim

#: Fixed: what the edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_NONE = 1 << 40
#: States of a repaired conversation: nothing yet, after the system row, after a user's row, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_TURNS = ((_START, _USER), (_SYSTEM, _USER), (_ASSISTANT, _USER), (_USER, _ASSISTANT))


class RepairTrie:
    """Answers for signatures in ascending order: one symbol a row, the initial of its role (`o`: another role), upper case if it is
    truncated, `-` if it must be deleted.

    The path to the last signature is a stack of layers; the next one keeps those of the common prefix. A layer holds, for each state, the least
    cost and the ASCII-least edits of that cost. Edits are nodes of a second tree with links to ancestors that halve the way, so
    that two of them are compared in logarithmic time. Of edits of one cost and state none begins another, as those which go on
    cost more; so the least of a prefix stays the least whatever follows.
    """

    def __init__(self) -> None:
        self.up, self.jump, self.depth, self.edit = [0], [0], [0], [""]
        self.done, self.layers, self.sizes = "", [self._inserted([(0, 0), *[(_NONE, 0)] * 3])], [len(self.up)]

    def _node(self, parent: int, edit: str) -> int:
        j = self.jump[parent]
        self.jump.append(self.jump[j] if self.depth[parent] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]] else parent)
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.edit.append(edit)
        return len(self.up) - 1

    def _ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.up[node]
        return node

    def _before(self, a: tuple[int, int, str], b: tuple[int, int, str]) -> bool:
        """Is candidate a (cost, edits so far, next edit) better than b?"""
        if a[0] != b[0]:
            return a[0] < b[0]
        (_, x, p), (_, y, q) = a, b
        least = min(self.depth[x], self.depth[y])
        i, j = self._ancestor(x, least), self._ancestor(y, least)
        if i == j:  # one goes on from the other
            p = self.edit[self._ancestor(x, least + 1)] if self.depth[x] > least else p
            q = self.edit[self._ancestor(y, least + 1)] if self.depth[y] > least else q
            return p < q
        while self.up[i] != self.up[j]:
            i, j = (self.jump[i], self.jump[j]) if self.jump[i] != self.jump[j] else (self.up[i], self.up[j])
        return self.edit[i] < self.edit[j]

    def _best(self, options: list[tuple[int, int, str]]) -> tuple[int, int, str]:
        best = options[0]
        for o in options[1:]:
            if self._before(o, best):
                best = o
        return best

    def _made(self, best: tuple[int, int, str]) -> tuple[int, int]:
        cost, node, edit = best
        return (cost, self._node(node, edit) if edit else node) if cost < _NONE else (_NONE, 0)

    def _inserted(self, layer: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The layer with empty rows inserted at its end where that is better: a user's, then an assistant's."""
        for target in (_USER, _ASSISTANT):
            options = [(layer[s][0] + INSERT, layer[s][1], "I") for s, t in _TURNS if t == target and layer[s][0] < _NONE]
            options += [(*layer[target], "")] * (layer[target][0] < _NONE)
            if options:
                layer[target] = self._made(self._best(options))
        return layer

    def _next(self, layer: list[tuple[int, int]], symbol: str) -> list[tuple[int, int]]:
        options: list[list[tuple[int, int, str]]] = [[(c + DELETE, n, "D")] if c < _NONE else [] for c, n in layer]
        if symbol != "-":
            role, more = symbol.lower(), TRUNCATED * symbol.isupper()
            if role == "s":
                options[_SYSTEM].append((layer[_START][0] + more, layer[_START][1], "K"))
            for s, t in _TURNS:
                cost, node = layer[s]
                if cost < _NONE:
                    keeps = role == ("u" if t == _USER else "a")
                    options[t].append((cost + more + (0 if keeps else REROLE), node, "K" if keeps else "R"))
        return self._inserted([self._made(self._best(o)) if o else (_NONE, 0) for o in options])

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature that isn't before the last one."""
        same, most = 0, min(len(signature), len(self.done))
        if signature[:most] == self.done[:most]:
            same = most
        else:
            lo, hi = 0, most  # the first lo symbols agree, the first hi don't
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if signature[:mid] == self.done[:mid] else (lo, mid)
            same = lo
        del self.layers[same + 1 :], self.sizes[same + 1 :]
        for nodes in (self.up, self.jump, self.depth, self.edit):
            del nodes[self.sizes[-1] :]
        for symbol in signature[same:]:
            self.layers.append(self._next(list(self.layers[-1]), symbol))
            self.sizes.append(len(self.up))
        self.done = signature
        ends = [(*self.layers[-1][s], "") for s in (_START, _ASSISTANT)]
        cost, node, _ = self._best([e for e in ends if e[0] < _NONE])
        edits = []
        while node:
            edits.append(self.edit[node])
            node = self.up[node]
        return cost, "".join(reversed(edits))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, gone) after damage by a checksum of conversation and turn; a dropped row stays, marked.

    Null roles and texts are one space.
    """
    names = {conv_col: "conv_id", turn_col: "turn", role_col: "role", text_col: "text"}
    d = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    how = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    d = d.select("conv_id", "turn", F.when(how == 4, "user").otherwise(_text("role")).alias("role"), F.when(how == 1, "").when(how == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text")).alias("text"), how.alias("how"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"), (F.col("how") == 0).alias("gone"))


_ORDER = ["turn", "role", "text", "copy"]


def _faults(rows: DataFrame, parts: int) -> DataFrame:
    """(conv_id, turn, gone, head, symbol, fault, illegal, new_turn) of damaged rows, each conversation's together and in order."""
    dealt = rows.repartition(parts, "conv_id")  # every window below needs no other exchange
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn", "copy")) > 1
    last = F.substring(F.regexp_replace("text", f"{SPACE}+$", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate").when(~last.rlike("[.!?]"), "truncated").otherwise("")
    order = Window.partitionBy("conv_id").orderBy("gone", *_ORDER)
    initial = F.substring("role", 1, 1)
    two = F.concat(F.lag(initial).over(order), initial)
    there = ~F.col("gone")
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    d = dealt.withColumn("fault", fault).withColumn("illegal", there & F.coalesce(~two.isin("su", "ua", "au"), F.lit(False))).withColumn("head", F.row_number().over(order) == 1)
    d = d.withColumn("new_turn", there & F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False)))
    symbol = F.when(F.col("gone"), "").when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return d.select("conv_id", "turn", "gone", "head", symbol.alias("symbol"), F.when(F.col("gone"), "").otherwise(F.col("fault")).alias("fault"), "illegal", "new_turn")


_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")


def conversation_faults(rows: DataFrame, parts: int, conv_type: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of damaged rows, a row for every conversation."""
    ship(rows.sparkSession)
    out_names = ["conv_id", "gaps", *_SUMS[:4], "signature"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        open_: list = []
        done: list[list] = []

        def closed() -> pa.RecordBatch:
            low, high = [r[1] for r in done], [r[2] for r in done]
            gaps = [min(h - lo + 1 - r[0][4], 2**63 - 1) if h is not None else 0 for lo, h, r in zip(low, high, done, strict=True)]
            cols = [pa.concat_arrays(ids[: len(done)]), pa.array(gaps, pa.int64()), *[pa.array([int(r[0][k]) for r in done], pa.int64()) for k in range(4)], pa.array(["".join(r[3]) for r in done], pa.string())]
            del ids[: len(done)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, out_names)

        for batch in batches:
            if not batch.num_rows:
                continue
            conv, head = column(batch, "conv_id"), column(batch, "head").to_numpy(zero_copy_only=False)
            turn = column(batch, "turn")
            there = ~column(batch, "gone").to_numpy(zero_copy_only=False)
            fault, symbols = column(batch, "fault").to_numpy(zero_copy_only=False), column(batch, "symbol").to_numpy(zero_copy_only=False)
            flags = np.stack([fault == f for f in _SUMS[:3]] + [column(batch, c).to_numpy(zero_copy_only=False) for c in ("illegal", "new_turn")]).astype(np.int64)
            real = there & turn.is_valid().to_numpy(zero_copy_only=False)
            turns = turn.fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(head)
            bounds = sorted({0, *starts.tolist(), len(head)})
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if head[lo]:
                    if open_:
                        done.append(open_.pop())
                    ids.append(conv.slice(lo, 1))
                    open_.append([np.zeros(5, np.int64), None, None, []])
                r = open_[0]
                r[0] += flags[:, lo:hi].sum(1)
                some = turns[lo:hi][real[lo:hi]]
                if len(some):
                    r[1] = int(some.min()) if r[1] is None else min(r[1], int(some.min()))
                    r[2] = int(some.max()) if r[2] is None else max(r[2], int(some.max()))
                r[3].append("".join(symbols[lo:hi]))
            if len(done) >= 5000:
                yield closed()
        if open_:
            done.append(open_.pop())
        if done:
            yield closed()

    return _faults(rows, parts).mapInArrow(scan, f"conv_id {conv_type}, gaps long, {', '.join(f'{c} long' for c in _SUMS[:4])}, signature string")


def repairs(signatures: DataFrame, parts: int) -> DataFrame:
    """(signature, cost, audit): the cheapest edits of each distinct signature, from a trie for each range of them."""
    ship(signatures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RepairTrie()
        for batch in batches:
            found = [trie.answer(s) for s in column(batch, "signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])
        trim()

    return signatures.select("signature").distinct().repartitionByRange(parts, "signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def repaired_rows(rows: DataFrame, plans: DataFrame, parts: int, conv_type: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """The repaired rows, each conversation's together and in order: conv_id, at (from 0), edit, role, text, and carried columns of plans.

    plans has conv_id, audit and carried longs; every plan gives a row with at = -1 first, whose edit is the whole audit.
    Tasks read damaged rows in order and hold one of them and its conversation's audit.
    """
    ship(rows.sparkSession)
    names = ["conv_id", "at", "edit", "role", "text", *carried]
    body = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy", F.lit("").alias("audit"), *[F.lit(None).cast("long").alias(c) for c in carried])
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copy"), "audit", *carried)
    dealt = body.unionByName(heads).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, done, at, last = "", 0, 0, "a"
        origin = None

        def inserts(out: list) -> None:
            nonlocal done, at, last
            while done < len(audit) and audit[done] == "I":
                last = "u" if last != "u" else "a"
                out.append((-1, at, "I", "user" if last == "u" else "assistant", ""))
                done, at = done + 1, at + 1

        def table(out: list, batch: pa.RecordBatch) -> pa.RecordBatch:
            conv = pa.concat_arrays([column(batch, "conv_id"), origin if origin is not None else column(batch, "conv_id").slice(0, 1)])
            where = pa.array([i if i >= 0 else batch.num_rows for i, *_ in out], pa.int64())
            more = [pa.concat_arrays([column(batch, c), pa.nulls(1, pa.int64())]).take(where) for c in carried]
            cols = [pa.array([r[k] for r in out], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()))]
            return pa.RecordBatch.from_arrays([conv.take(where), *cols, *more], names)

        for batch in batches:
            out: list[tuple] = []
            kind, conv = column(batch, "kind").to_pylist(), column(batch, "conv_id")
            for i, (k, role, text, plan) in enumerate(zip(kind, *(column(batch, c).to_pylist() for c in ("role", "text", "audit")), strict=True)):
                if k == 0:
                    if origin is not None:
                        inserts(out)
                        if out:
                            yield table(out, batch)
                            out = []
                    audit, done, at, last, origin = plan, 0, 0, "a", conv.slice(i, 1)
                    out.append((i, -1, plan, None, None))
                    continue
                inserts(out)
                edit, done = audit[done], done + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "user" if last != "u" else "assistant"
                last = role[:1]
                out.append((i, at, edit, role, text))
                at += 1
            if out:
                yield table(out, batch)
        if origin is not None:
            out = []
            inserts(out)
            if out:
                empty = pa.RecordBatch.from_arrays([origin.slice(0, 0), *[pa.nulls(0, pa.int64())] * len(carried)], ["conv_id", *carried])
                yield table(out, empty)

    schema = f"conv_id {conv_type}, at long, edit string, role string, text string" + "".join(f", {c} long" for c in carried)
    return dealt.mapInArrow(run, schema)


_RESULT = ("gaps", *_SUMS[:4], "cost")


def _digests(repaired: DataFrame, conv_type: str) -> DataFrame:
    """(conv_id, the carried columns, audit, repaired_sha256) from rows of repaired_rows, folded in their order."""
    names = ["conv_id", *_RESULT, "audit", "repaired_sha256"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, h = None, None
        for batch in batches:
            ready: list[pa.RecordBatch] = []
            shas: list[str] = []
            for i, (at, role, text) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("at", "role", "text")), strict=True)):
                if at < 0:
                    if head is not None:
                        ready.append(head)
                        shas.append(h.hexdigest())
                    head, h = batch.slice(i, 1), hashlib.sha256()
                else:
                    h.update(("\n" * (at > 0) + f"{role}:{text}").encode())
            if ready:
                yield _row(ready, shas)
        if head is not None:
            yield _row([head], [h.hexdigest()])
        trim()

    def _row(heads: list[pa.RecordBatch], shas: list[str]) -> pa.RecordBatch:
        t = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([column(t, "conv_id"), *(column(t, c) for c in _RESULT), column(t, "edit"), pa.array(shas, pa.string())], names)

    return repaired.mapInArrow(fold, f"conv_id {conv_type}, {', '.join(f'{c} long' for c in _RESULT)}, audit string, repaired_sha256 string")


def _planned(conversations: DataFrame, part_bytes: int, **kw) -> tuple[DataFrame, DataFrame, int, str]:
    rows = damaged(conversations, **kw)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    parts = parts_for(text_bytes(conversations, kw.get("text_col", "text")), part_bytes)
    found = save(conversation_faults(rows, parts, conv_type), "conversation-faults")
    return rows, found.join(repairs(found, parts), "signature").drop("signature"), parts, conv_type


def repair_conversations(conversations: DataFrame, part_bytes: int = 16 << 20, **kw) -> DataFrame:
    """The rows of all repaired conversations: conv_id, at (position from 0), edit (K kept, R another role, I inserted), role, text."""
    rows, plans, parts, conv_type = _planned(conversations, part_bytes, **kw)
    return repaired_rows(rows, plans.select("conv_id", "audit"), parts, conv_type).where("at >= 0")


def repair_digest(conversations: DataFrame, part_bytes: int = 16 << 20, **kw) -> DataFrame:
    """One row for every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (null first), rows of one turn by role, text and copy. A conversation whose rows are all dropped has zeros,
    an empty audit and the digest of an empty string; a null conv_id is a conversation like others; other columns are
    ignored; an empty table gives an empty result. `gaps` beyond 64 bits is the greatest long.

    A conversation's rows meet in one task, as its digest is one hash in their order; there they are sorted on disk
    and streamed, so that a long conversation takes time but no memory beyond its audit. Signatures, a byte a row, are the only thing
    that the search sees: equal ones are solved once, and ranges of them share the layers of their prefixes.
    """
    rows, plans, parts, conv_type = _planned(conversations, part_bytes, **kw)
    return _digests(repaired_rows(rows, plans, parts, conv_type, _RESULT), conv_type)
