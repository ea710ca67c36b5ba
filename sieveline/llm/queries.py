"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_digest
from .common import text_bytes
from .conversations import repair_digest
from .conversations_sql import OP12
from .divergence import source_divergence
from .divergence_sql import OP13
from .embedding_dedup import near_embeddings
from .exact import exact_dedup
from .jaccard import ngram_jaccard
from .language_id import language_id
from .license_scan import scan_licenses
from .lm_scoring import marked_difference
from .mixing import mix_sources
from .packing import pack_digest
from .secret_scan import BASE, RULES, secret_digest
from .substring import substring_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    target = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id"), F.lit(True).alias("good")).distinct()
    marked = docs.select("doc_id", "text").join(target.hint("merge"), "doc_id", "left")  # labels grow with the corpus
    return marked_difference(marked.select(F.col("doc_id").cast("long"), "text", F.lit(True).alias("scored"), F.coalesce("good", F.lit(False)).alias("target")), text_bytes(docs))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"), n_words=4, percent=85)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP1 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
c(id, root) as (select vec_id, vec_id from embeddings union select c.id, l.b from c join l on c.root = l.a),
n as (select a, count(*) as n from l group by a)
select id as vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(root) as component_id, id = min(root) as kept
from c left join n on n.a = c.id group by id
"""

_OP2 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('0:' || doc_id) as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select source, source_size, [3, 1, 2][1 + ((row_number() over (order by source nulls last) - 1) % 3)] as weight
  from s),
-- Sources are clamped in the order of their size for a unit of weight.
r as (select *, row_number() over (order by source_size / weight, source nulls last) as k from w),
c as (
  select *, coalesce(sum(2 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as clamped,
         sum(weight) over (order by k rows between current row and unbounded following) as free,
         1.5::double * sum(source_size) over () as total
  from r),
l as (select *, (total - clamped) / free as level from c),
f as (select min(k) as k, min_by(level, k) as level from l where level * weight <= 2 * source_size),
t as (
  select r.source, r.source_size, case when r.k >= f.k then f.level * r.weight else (2 * r.source_size)::double end as target
  from r left join f on true),
u as (
  select d.*, t.source_size, t.target, floor(target / nullif(t.source_size, 0)) as whole,
         sum(size) over (partition by d.source order by h, doc_id rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       (size * (coalesce(whole, 0) + case when 2 * upto - size <= 2 * case when coalesce(whole, 0) < 2 then target - coalesce(whole, 0) * source_size else 0 end then 1 else 0 end))::bigint as taken
from u
"""

_OP3 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
x as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from k),
f as (select doc_id, i, min(doc_id) over (partition by s) as first_id from x),
c as (select distinct doc_id, unnest(range(i, i + 13)) as p from f where first_id < doc_id),
g as (select doc_id, list(p) as gone from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(case when gone is null then w else [w[p] for p in range(1, len(w) + 1) if not list_contains(gone, p)] end, ' ')) as kept_sha256
from d left join g using (doc_id)
"""

_OP4 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as content
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by content) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(content) as text_sha256
from d
window w as (partition by content order by points desc, doc_id)
"""


_OP10 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) >= 4 then list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
         when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from d),
t as (select doc_id, len(s) as n, unnest(s) as t from s),
l as (
  select a.doc_id as a, b.doc_id as b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
c(id, root) as (select doc_id, doc_id from documents union select c.id, l.b from c join l on c.root = l.a)
select id as doc_id, any_value(len(s))::bigint as n_shingles, min(root) as component_id
from c join s on s.doc_id = c.id group by id
"""


def _op7() -> str:
    """Spans from the lengths of the matches and of what lies between them; all rules search every text."""
    found = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(f"""select doc_id, {k} as k, unnest([{{'s': list_sum([length(x) for x in b[1:i]])::bigint + coalesce(list_sum([length(x) for x in w[1:i - 1]]), 0)::bigint, 'n': length(w[i]), 'g': length(g[i])}} for i in range(1, len(w) + 1)]) as m, {r.least} as least
          from (select doc_id, string_split_regex(text, '{p}') as b, regexp_extract_all(text, '{p}') as w, regexp_extract_all(text, '{p}', {r.group}) as g from d)""")
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    span = f"{names}[k + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) filter (k = {k}) as n_{r.kind}" for k, r in enumerate(BASE))
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents),
    m as (select doc_id, k, m.s as s, m.s + m.n as e from ({" union all ".join(found)}) where m.g >= least),
    a as (select doc_id, {counts}, string_agg({span}, ',' order by s, k) filter (k < {len(BASE)}) as base, string_agg({span}, ',' order by s, k) as spans from m group by doc_id)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_bpe": op6_bpe,
        "op7_secret_scan": op7_secret_scan,
        "op8_license_scan": op8_license_scan,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": _OP1,
        "op2_mix_sources": _OP2,
        "op3_substring_dedup": _OP3,
        "op4_exact_dedup": _OP4,
        "op7_secret_scan": _op7(),
        "op10_ngram_jaccard": _OP10,
        "op12_conversation_repair": OP12,
        "op13_source_divergence": OP13,
    }
