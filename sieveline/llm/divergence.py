"""Divergence of sources within a language: DuckDB counts and compares shards of terms, Spark merges sums and rankings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.session import ship

from .common import column, parts_for, save, text_bytes, trim

#: Fixed: what a term is, and the letters that are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed: the scale of shares and what is added to each count.
SCALE, ADDED = 1_000_000_000, 5

_COUNT = f"""
select lang, source, term, sum(c)::bigint as n, count(*) as docs from (
  select row, lang, source, term, count(*) as c from (
    select row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term
    from (select row_number() over () as row, * from part))
  group by all)
group by all"""
_MERGE = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from part group by all"
_KEEP = "select lang, source, term, n from (select *, sum(docs) over (partition by lang, term) as all_docs from ({merged})) where all_docs >= {least}"
#: p of a count, from its group's sum and the language's terms; all in 128 bits.
_SHARE = f"(1 + {SCALE}::hugeint * ({{n}} + {ADDED}) // ({{total}} + {ADDED}::hugeint * terms))"
_PAIRS = f"""
with p as (select lang, source, term, none, {_SHARE.format(n="n", total="total")} as p from part)
select a.lang, a.source, b.source as other, sum(abs(a.p - b.p) - abs(a.p - b.none) - abs(a.none - b.p) + abs(a.none - b.none))::bigint as value
from p a join p b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all"""
_TOP = f"""
select lang, source, term, f::bigint as value from (
  select *, p - q as f, row_number() over (partition by lang, source order by p - q desc, term) as rank from (
    select lang, source, term, {_SHARE.format(n="n", total="total")} as p, {_SHARE.format(n="all_n", total="lang_total")} as q
    from (select *, sum(n) over (partition by lang, term) as all_n from part))
  where p > q)
where rank <= {{top}}"""


def _connect():
    """DuckDB in this task: one thread, nothing written to disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})


def _ask(con, sql: str, part) -> pa.Table:
    con.register("part", part)
    out = con.sql(sql).to_arrow_table()
    con.unregister("part")
    return out


def _plain(t: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of the names with plain strings."""
    t = t.select(names)
    schema = pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) or pa.types.is_string(f.type) else pa.int64()) for f in t.schema])
    yield from t.cast(schema).to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = 150_000, piece: int = 1 << 19) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, partial sums of tasks.

    Every `piece` bytes of text or so are counted by one SQL statement; a task merges its counts and sends them once there
    are `most`.
    """
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        with _connect() as con:
            for batch in batches:
                step = max(1, batch.num_rows * piece // max(1, batch.nbytes))
                for lo in range(0, batch.num_rows, step):
                    held.append(_ask(con, _COUNT, pa.Table.from_batches([batch.slice(lo, step)])))
                    if sum(t.num_rows for t in held) >= 2 * most:
                        held = [_ask(con, _MERGE, pa.concat_tables(held))]
                        trim()
                        if held[0].num_rows >= most:
                            yield from _plain(held.pop(), names)
            if held:
                yield from _plain(_ask(con, _MERGE, pa.concat_tables(held)), names)
        trim()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    return docs.select(*named).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _sharded(df: DataFrame, shards: int, most_tasks: int = 8192) -> DataFrame:
    """df with the shard of its language and term; a task has four shards, or more when there are very many."""
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    return df.withColumn("shard", shard).repartition(max(1, min(shards // 4, most_tasks)), "shard")


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_bytes: int = 4 << 20) -> DataFrame:
    """How the sources of each language differ in their words: lang, source, part, item, value, rank.

    Terms are runs of letters (ASCII ones lower-cased) and other characters beyond ASCII. A language keeps the terms that at
    least `least` of its documents hold, V of them. A group's share of a term is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N
    being its kept occurrences. Part `pair` has a row for every other source of the language: the sum of |p - q| over all kept
    terms. Part `term` has the `top` kept terms that occur in the group and whose p is above the language's. Ranks go by value
    descending, then by item in UTF-8 order.

    Null text, language or source counts as ''. Groups without a term take part with equal shares; a language without kept terms
    gives pairs of value 0. Ids, other columns and the order of rows don't matter; repeated rows are documents of their own;
    an empty table gives an empty result.

    Counts are dealt by hash of language and term. A task merges what it has read first, so a frequent term sends a row for each
    task and source. DuckDB streams a shard's rows, of about `shard_bytes` of text. Pairs cost the squares of the
    sources that share a term, not of all: a term's absent sources have one share each, so their part of a sum follows from
    how often each count occurs, which Spark adds up.
    """
    spark = docs.sparkSession
    shards = parts_for(text_bytes(docs, text_col), shard_bytes, 48)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connect() as con:
            reader = pa.RecordBatchReader.from_batches(_COUNTS, (b.select(_COUNTS.names) for b in batches))
            found = _ask(con, _KEEP.format(merged=_MERGE, least=least), reader)
        yield from _plain(found, ["lang", "source", "term", "n"])
        trim()

    kept = _sharded(term_counts(docs, text_col, lang_col, source_col), shards).groupBy("shard").applyInArrow(keep, "lang string, source string, term string, n long")
    kept = save(kept, "divergence-terms")

    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    none = F.expr(f"case when terms > 0 then 1 + cast({SCALE * ADDED}L div (total + {ADDED} * terms) as bigint) else 0 end")
    groups = save(groups.withColumn("none", none), "divergence-groups")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connect() as con:
            part = pa.Table.from_batches(list(batches)).drop_columns(["shard"])
            pairs, best = _ask(con, _PAIRS, part), _ask(con, _TOP.format(top=top), part)
        for t, kind in ((pairs.rename_columns(["lang", "source", "item", "value"]), "pair"), (best.rename_columns(["lang", "source", "item", "value"]), "term")):
            for b in _plain(t, ["lang", "source", "item", "value"]):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([kind] * b.num_rows)], names=["lang", "source", "item", "value", "part"])
        trim()

    known = _sharded(kept.join(groups, ["lang", "source"]), shards)
    parts = save(known.groupBy("shard").applyInArrow(compare, "lang string, source string, item string, value long, part string"), "divergence-parts")

    # Sums over the terms that a source holds, against each other source's share of terms that it doesn't hold.
    levels = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(groups, ["lang", "source"])
    p = F.expr(f"1 + cast(({SCALE} * cast(n + {ADDED} as decimal(38, 0))) div (total + {ADDED} * terms) as bigint)")
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    against = levels.select("lang", "source", "m", "none", p.alias("p")).join(others, "lang").where("source != other")
    alone = against.groupBy("lang", "source", "other").agg(F.sum(F.expr("m * (abs(p - other_none) - abs(none - other_none))")).alias("value"))
    every = groups.join(others, "lang").where("source != other").select("lang", "source", "other", F.expr("terms * abs(none - other_none)").alias("value"))
    both = parts.where("part = 'pair'").select("lang", "source", F.col("item").alias("other"), "value")
    turned = [d.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value") for d in (both, alone)]
    pairs = every.unionByName(both).unionByName(alone).unionByName(turned[0]).unionByName(turned[1]).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
