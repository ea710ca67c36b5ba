"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import save

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose `group` has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed: the base kinds. A dropped match of `access` or `hex` can hide no other one, so their least length stands in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of further credentials.
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + EXTRA

#: A query is None (no condition), a trigram, or ("and" | "or", queries).
_MOST = 24


def _both(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list) -> object:
    if any(p is None for p in parts):
        return None
    held = {p: set(p[1]) if p[0] == "and" else {p} for p in dict.fromkeys(parts)}
    kept = tuple(p for p in held if not any(held[q] < held[p] for q in held))
    return kept[0] if len(kept) == 1 else ("or", kept)


def _of_strings(strings: set[str]) -> object:
    """What holds if one of the strings occurs; trigrams are compared in lower case."""
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(x.lower() for x in strings)]) if strings else None


def _exact(items) -> set[str] | None:
    """All strings that a sequence of nodes matches, if these are few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            here = {chr(arg)}
        elif op is sre.SUBPATTERN:
            here = _exact(arg[-1])
        elif op is sre.BRANCH:
            each = [_exact(b) for b in arg[1]]
            here = None if None in each else set().union(*each)
        elif op is sre.IN and arg[0][0] is not sre.NEGATE:
            here = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    here.add(chr(x))
                elif kind is sre.RANGE and x[1] - x[0] < _MOST:
                    here |= set(map(chr, range(x[0], x[1] + 1)))
                else:
                    return None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
            one = _exact(arg[2])
            here = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in ([()] if n == 0 else [(a,) for a in one] if n == 1 else [(a, b) for a in one for b in one])}
        else:
            here = None
        if here is None or len(out) * len(here) > _MOST:
            return None
        out = {a + b for a in out for b in here}
    return out


def _needs(items) -> object:
    """The trigram query of a sequence of nodes: literal runs are joined as far as their strings stay few."""
    parts, run = [], {""}
    for node in items:
        here = _exact([node])
        if here is not None and len(run) * len(here) <= _MOST:
            run = {a + b for a in run for b in here}
            continue
        parts.append(_of_strings(run))
        run = {""}
        op, arg = node
        if here is not None:
            run = here
        elif op is sre.SUBPATTERN:
            parts.append(_needs(arg[-1]))
        elif op is sre.BRANCH:
            parts.append(_either([_needs(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_needs(arg[2]))
    return _both([*parts, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match fulfils; None if the pattern has no mandatory trigram."""
    return _needs(parser.parse(pattern))


def trigrams(query: object) -> list[str]:
    return [] if query is None else [query] if isinstance(query, str) else sorted({t for q in query[1] for t in trigrams(q)})


def build_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text", per_block: int = 16_384) -> DataFrame:
    """The inverted index (block, trigram, ids): postings of the trigrams in vocabulary, in blocks of about `per_block` ids.

    An id is posted if one of its rows has the trigram in its lower case. Rows with a null id aren't posted.
    """
    blocks = max(12, -(-docs.count() // per_block))
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    rows = low.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(held).alias("trigram"), "doc_id")
    return rows.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("ids"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): for each id in the result of a rule's query, intersections and unions of postings, the numbers of such rules."""
    queries = [(i, q) for i, q in enumerate(trigram_query(r.pattern) for r in rules) if q is not None]
    postings = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("of"))
    none = F.filter(F.flatten(F.map_values("of")), lambda x: F.lit(False))

    def found(q: object) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.col("of")[F.lit(q)], none)
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, map(found, q[1]))

    each = F.array(*[F.struct(F.lit(i).alias("rule"), found(q).alias("ids")) for i, q in queries])
    rows = postings.select(F.explode(each).alias("x")).select("x.rule", F.explode("x.ids").alias("doc_id"))
    return rows.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, from the lengths of the matches and of what lies between them.

    Lengths are added up in chunks of the square root of their number, and chunks after that, as an array that grows by one
    element a step would be copied every time.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole")
    part = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part")] if rule.group else []
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("between"), whole, *part)
    fits = lambda m: F.coalesce(F.length(m["part" if part else "whole"]) >= rule.least, F.lit(False))
    lengths = F.transform(zipped, lambda m: F.struct(F.length(m["between"]).alias("gap"), F.coalesce(F.length(m["whole"]), F.lit(0)).alias("own"), fits(m).alias("fits")))

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + m["gap"]
        end = start + m["own"]
        found = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["fits"], F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    def chunked(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        chunk = lambda i: F.aggregate(F.slice(x, i * size + 1, size), F.struct(F.lit(0).alias("at"), none.alias("out")), step)
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), chunk)

    def shifted(a: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + a["at"]).alias("end")))
        return F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["outs"], F.array(moved)).alias("outs"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int>>>").alias("outs"))
    found = F.aggregate(_bound(lengths, chunked), start, shifted, lambda a: F.flatten(a["outs"]))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, text and spans, an array of (start, kind number, end) in order; ends are exclusive.

    Matches are those that a leftmost, non-overlapping search for each rule finds, less those too short. Only rows whose id is
    in the result of a rule's trigram query are searched for it; rules that need no trigram search every row. The index may
    be given (see build_index), or is built and stored. Null text is empty and has no spans. An id's postings are those of all
    its rows; rows with a null id are searched for every rule. Spans of one row gather in one array, so a text needs memory in
    proportion to its own matches.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    words = sorted({t for q in queries for t in trigrams(q)})
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if words:
        found = candidates(index if index is not None else save(build_index(d, words), "trigram-index"), rules)
        d = d.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        d = d.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    searched = lambda i: F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", F.lit(i)), F.lit(False))
    each = [_spans(F.col("text"), i, r) if queries[i] is None else F.when(searched(i), _spans(F.col("text"), i, r)).otherwise(none) for i, r in enumerate(rules)]
    return d.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, numbers of spans of the base kinds, a digest of these, and all spans as text."""
    found = scan_secrets(docs, **kw).select("doc_id", "spans")
    of = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
