"""The same queries in DuckDB SQL, where it can express them."""

from __future__ import annotations

#: Named parts; each may use those before it.
PARTS = {
    "ord": """select o_orderkey as row_id, o_totalprice as total, n_lines, quantity, price, discount, tax, y
      from orders join (select l_orderkey, count(*)::double as n_lines, sum(l_quantity) as quantity, sum(l_extendedprice) as price,
        avg(l_discount) as discount, avg(l_tax) as tax, max((l_returnflag = 'R')::int) as y from lineitem group by l_orderkey) on o_orderkey = l_orderkey""",
    "ordl": "select row_id, y, unnest(range(6))::int as f, unnest([total, n_lines, quantity, price, discount, tax]) as x from ord",
    "doc": """select doc_id as row_id, n_chars::double as chars, (length(text) - length(replace(text, ' ', '')))::double as spaces,
        (length(text) - length(replace(text, chr(10), '')))::double as newlines, (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::double as digits, quality::int as y
      from documents join labels using (doc_id)""",
    "docl": "select row_id, y, unnest(range(4))::int as f, unnest([chars, spaces, newlines, digits]) as x from doc",
    "emb": "select vec_id as row_id, embedding as e, label::int as y from embeddings",
    "embl": "select row_id, y, unnest(range(64))::int as f, unnest(e)::double as x from emb",
    "usr0": """select user_id as row_id, count(*) filter (event_type = 'click')::double as click, count(*) filter (event_type = 'view')::double as view,
        count(*) filter (event_type = 'error')::double as error, count(*) filter (event_type = 'signup')::double as signup, avg(value) as avg_value,
        max(value) as max_value, stddev_samp(value) as std_value, avg(json_extract_string(props, '$.k')::double) as avg_k, count(*) filter (event_type = 'purchase') as bought
      from events group by user_id""",
    "usr": "select * exclude (bought), (bought > (select median(bought) from usr0))::int as y from usr0",
    "usrl": "select row_id, y, unnest(range(8))::int as f, unnest([click, view, error, signup, avg_value, max_value, std_value, avg_k]) as x from usr",
    "hord": "select row_id, y, f, case when row_id % 17 <> f % 17 then x end as x from ordl",
    "iord": "select row_id, y, f, coalesce(x, median(x) over (partition by f)) as x from hord",
    "zord": "select row_id, y, f, (x - avg(x) over (partition by f)) / stddev_pop(x) over (partition by f) as x from iord",
    "hdoc": "select row_id, y, f, case when row_id % 17 <> f % 17 then x end as x from docl",
    # one-way F from classes' sums of values off the mean
    "fc": "select f, y, count(*)::double as n, sum(x - m) as s, sum((x - m) * (x - m)) as q from (select *, avg(x) over (partition by f) as m from {long}) group by f, y",
    "fa": "select f, count(*) as k, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as b from fc group by f",
    "anova": "select f, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) as score from fa",
    "rel": "select f, score / max(score) over () as score from anova",
    "mb": "select unnest([0, 1, 2, 3, 4, 5])::int as f, unnest([0, 1, 1, 1, 0, 0])::double as score",
    # absolute correlations of every two features
    "mom": "select f, avg(x) as m, stddev_pop(x) as s from {long} group by f",
    "pairs": """select f_i, f_j, case when si * sj > 0 then least(abs(c / (si * sj)), 1) else 0 end as abs_corr
      from (select a.f as f_i, b.f as f_j, avg((a.x - ma.m) * (b.x - mb.m)) as c, max(ma.s) as si, max(mb.s) as sj
        from {long} a join {long} b on a.row_id = b.row_id and a.f < b.f join mom ma on ma.f = a.f join mom mb on mb.f = b.f group by a.f, b.f)""",
    "edges": "select f_i, f_j, abs_corr as weight from pairs where abs_corr >= 0.1",
    "degree": "select f, coalesce(s / max(s) over (), 0) as score from (select r.f, sum(weight) as s from (select unnest(range(6))::int as f) r left join edges on f_i = r.f or f_j = r.f group by r.f)",
    "gap": "select f_i, f_j, abs_corr, abs(a.score - b.score) as g from pairs join rel a on a.f = f_i join rel b on b.f = f_j",
    "hyb": "select f_i, f_j, 1 - abs_corr as d_stat, g / max(g) over () as d_causal, greatest(0.5 * (1 - abs_corr) + 0.5 * g / max(g) over (), 0) as d_hybrid from gap",
    # results of five data sets, eight methods and three seeds
    "res": """select o_orderpriority as dataset, ['Proposed', 'PCA', 'VAE', 'LASSO', 'mRMR', 'CausalDRIFT', 'CAFE', 'Random'][1 + o_custkey % 8] as method,
        (o_orderkey % 3)::int as seed, 10 as k, round(avg(o_totalprice) / 500000, 3) as accuracy, round(count(*) / 100, 1) as stability, round(max(o_totalprice) / 600000, 2) as trustworthiness,
        round(min(o_totalprice) / 1000, 2) as runtime_s, case when o_orderpriority not like '1%' then round(avg(o_totalprice) / 400000, 2) end as causal_plausibility,
        case when o_orderpriority not like '1%' then round(max(o_totalprice) / 700000, 2) end as causal_recall
      from orders group by o_orderpriority, 2, 3""",
    "means": "select method, round(avg(accuracy), 12) as accuracy, round(avg(stability), 12) as stability, round(avg(trustworthiness), 12) as trustworthiness, round(avg(runtime_s), 12) as runtime_s from res group by method",
    "dm": "select dataset, method, round(avg(accuracy), 12) as accuracy, round(avg(stability), 12) as stability, round(avg(trustworthiness), 12) as trustworthiness, round(avg(runtime_s), 12) as runtime_s from res group by dataset, method",
    "mo": "select unnest(['Proposed', 'PCA', 'VAE', 'LASSO', 'mRMR', 'CausalDRIFT', 'CAFE', 'Random']) as method, unnest(range(8))::int as position",
    # selections and reviews
    "sel": """select b, a[b % 3 + 1:b % 3 + 4] as selected from (select (l_orderkey % 5)::int as b,
        list_sort(list(distinct (floor(l_extendedprice) % 7 + l_orderkey % 3)::int)) as a from lineitem group by 1)""",
    "votes": "select f, count(*) as votes, count(*) / (select count(*) from sel) as share, (row_number() over (order by count(*) desc, f))::int as rank from (select distinct b, unnest(selected) as f from sel) group by f",
    "two": "select x.b as b1, y.b as b2, x.selected as s1, y.selected as s2 from sel x join sel y on x.b < y.b",
    "clu": "select unnest([0, 1, 2, 3, 4, 5])::int as f, unnest([0, 1, 1, 1, 2, 2])::int as cluster",
    "mer": """select * from (values (0, [2], [3], 0.1::double), (1, [1], [2, 3], 0.13), (2, [0], [4], 0.5), (3, [0, 4], [1, 2, 3], 0.7), (4, [0, 1, 2, 3, 4], [5], 0.72)) t(step, l, r, distance)""",
    "side": """select step, avg(rel.score) filter (s = 'l') as rl, avg(rel.score) filter (s = 'r') as rr, max(mb.score) filter (s = 'l') as ml, max(mb.score) filter (s = 'r') as mr
      from (select step, 'l' as s, unnest(l) as f from mer union all select step, 'r', unnest(r) from mer) join rel using (f) join mb using (f) group by step""",
    "rev": """select * from (select step, l, r, distance, coalesce(lead(distance) over (order by step), distance) as next_distance,
        abs(distance - coalesce(lead(distance) over (order by step), distance)) / (max(distance) over () - min(distance) over ()) as distance_gap, abs(rl - rr) as causal_gap, (ml > 0) <> (mr > 0) as conflicting
      from mer join side using (step)) where distance_gap <= 0.05 or conflicting""",
    "dec": "select *, not (conflicting or causal_gap >= 0.4) as decision from rev",
    "vp": "select distinct least(a, b)::int as f_i, greatest(a, b)::int as f_j from (select unnest(l) as a, r from dec where not decision) cross join lateral (select unnest(r) as b)",
    # neighbours of other folds
    "fold": "select row_id, y, ((row_number() over (partition by y order by row_id) - 1) % least(5, greatest(2, (select min(n) from (select count(*) as n from {wide} group by y)))))::int as fold from {wide}",
    "near": """select a.row_id, a.fold, a.y, b.y as yb, row_number() over (partition by a.row_id order by {dist}, b.row_id) as r
      from (select * from fold join {wide} using (row_id, y)) a join (select * from fold join {wide} using (row_id, y)) b on a.fold <> b.fold""",
    "pred": """select row_id, fold, y, yb as predicted from (select row_id, fold, y, yb, row_number() over (partition by row_id order by count(*) desc, yb) as o
      from near where r <= 5 group by row_id, fold, y, yb) where o = 1""",
    "fk": "select (length(method) - 2)::int as k, accuracy as perf, 1 - trustworthiness as redundancy, accuracy from res",
    "fs": "select k, avg(perf) as mean_perf, case when count(*) > 1 then stddev_samp(perf) / sqrt(count(*)) else 0 end as se_perf, avg(redundancy) as redundancy, avg(accuracy) + 0.3 as stability from fk group by k",
}


def sql(parts: str, select: str, **names: str) -> str:
    """A query over named parts; {names} inside parts are filled in."""
    ctes = []
    for p in parts.split():
        body = PARTS[p]
        for key, value in names.items():
            body = body.replace("{" + key + "}", value)
        ctes.append(f"{p} as ({body})")
    return f"with {', '.join(ctes)} {select}" if ctes else select


def r6(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 as {c}" for c in columns)


ORD = ("total", "n_lines", "quantity", "price", "discount", "tax")
DOC = ("chars", "spaces", "newlines", "digits")
USR = ("click", "view", "error", "signup", "avg_value", "max_value", "std_value", "avg_k")
METRICS = ("accuracy", "stability", "trustworthiness", "runtime_s")
METHODS = ("Proposed", "PCA", "VAE", "LASSO", "mRMR", "CausalDRIFT", "CAFE", "Random")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def wide(names: tuple[str, ...], source: str, y: bool = True, places: int = 6) -> str:
    cells = ", ".join(f"round(max(x) filter (f = {i}), {places}) + 0.0 as {c}" for i, c in enumerate(names))
    return f"select row_id, {'y, ' if y else ''}{cells} from {source} group by row_id, y"


def pivoted(metric: str, rows: str, column: str, names: tuple[str, ...], source: str = "res") -> str:
    cells = ", ".join(f"round(avg({metric}) filter ({column} = '{n}'), 12) as \"{n}\"" for n in names)
    return f"select {rows}, {cells} from {source} group by {rows}"


_SUPPLIERS = """with raw as (select s_suppkey as id, case when s_suppkey % 7 <> 0 then s_acctbal end as balance, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey),
 seen as (select n_name, row_number() over (order by min(id)) - 1 as code from raw group by n_name)
select id as row_id, (dense_rank() over (order by n_regionkey) - 1)::int as y, round(coalesce(balance, median(balance) over ()), 6) + 0.0 as balance, code::double as nation from raw join seen using (n_name)"""

_MI = """, u as (select * from {long} t where (select count(*) from {long} s where s.f = t.f and s.y = t.y) > 1),
 d as (select a.f, a.row_id, a.x, abs(a.x - b.x) as d, row_number() over (partition by a.f, a.row_id order by abs(a.x - b.x)) as k, count(*) over (partition by a.f, a.row_id) as others from u a join u b on a.f = b.f and a.y = b.y and a.row_id <> b.row_id),
 rad as (select f, row_id, x, d as r, least(3, others) as k, others + 1 as nc from d where k = least(3, others)),
 cnt as (select rad.f, rad.row_id, any_value(rad.k) as k, any_value(nc) as nc, count(*) as m from rad join u on u.f = rad.f and (u.x = rad.x or (u.x > rad.x - r and u.x < rad.x + r)) group by rad.f, rad.row_id),
 top as (select f, count(*) as n from u group by f),
 har as (select i, coalesce(sum(1.0 / (i - 1)) filter (i > 1) over (order by i), 0)::double as h from (select unnest(range(1, 200001)) as i)),
 mi as (select cnt.f, greatest(0, any_value(ht.h) + avg(hk.h) - avg(hc.h) - avg(hm.h)) as score from cnt join top using (f) join har ht on ht.i = top.n join har hk on hk.i = cnt.k join har hc on hc.i = nc join har hm on hm.i = m group by cnt.f)"""

_SAMPLE = """q as (select y, count(*) as n, {most} * count(*) / sum(count(*)) over () as share from {source} group by y),
 q2 as (select y, floor(share)::int + (row_number() over (order by floor(share) - share, y) <= {most} - sum(floor(share)) over ())::int as quota from q),
 h as (select row_id, y, row_number() over (partition by y order by md5('42:' || row_id), row_id) as k from {source})"""

ORACLES: dict[str, str] = {
    "csv_source": _SUPPLIERS,
    "question_mark_codes": """with seen as (select p_size, row_number() over (order by min(p_partkey)) - 1 as code from part where p_partkey % 5 <> 0 group by p_size)
      select p_partkey as row_id, (dense_rank() over (order by p_brand) - 1)::int as y, case when p_partkey % 5 = 0 then -1 else code end::double as size from part left join seen using (p_size)""",
    "question_mark_to_null": "select c_custkey, case when c_custkey % 11 <> 0 then c_mktsegment end as segment from customer",
    "codes_by_first_appearance": """with s as (select c_mktsegment, row_number() over (order by min(c_custkey)) - 1 as code from customer where c_custkey % 13 <> 0 group by 1)
      select c_custkey, case when c_custkey % 13 = 0 then -1 else code end::double as code from customer left join s using (c_mktsegment)""",
    "label_codes": "select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as code from orders",
    "catalogue_load": sql("usr0 usr", f"select row_id, y, {r6(*USR)} from usr"),
    "catalogue_offline": sql("ord emb usr0 usr", """, t as (select 'orders' as name, 2 as n_classes, y from ord union all select 'embeddings', 10, y from emb
      union all select 'documents-quality', 2, quality::int from documents join labels using (doc_id) union all select 'documents-toxic', 2, toxic::int from documents join labels using (doc_id)
      union all select 'users', 2, y from usr) select name, any_value(n_classes) as n_classes, count(distinct y) as n_found, count(*) as n_rows from t group by name"""),
    "ordered_fallbacks": sql("doc", f"select row_id, y, {r6(*DOC)} from doc"),
    "cached_frame": sql("doc", f"select row_id, toxic::int as y, {r6(*DOC)} from doc join labels on row_id = doc_id"),
    "results_round_trip": sql("res", "select * from res"),
    "median_impute": sql("doc docl hdoc", "select row_id, y, " + ", ".join(f"round(coalesce(max(x) filter (f = {i}), any_value(m{i})), 6) + 0.0 as {c}" for i, c in enumerate(DOC)) + " from hdoc, (select " + ", ".join(f"median(x) filter (f = {i}) as m{i}" for i in range(4)) + " from hdoc) group by row_id, y"),
    "variance_cap": sql("emb embl", "select row_id, (row_number() over (partition by row_id order by f) - 1)::int as f, round(x, 6) + 0.0 as x from embl where f in (select f from embl group by f order by var_pop(x) desc, f desc limit 12)"),
    "stratified_sample": sql("ord", ", ".join(["select row_id, y from h join q2 using (y) where k <= quota"])).replace(" select row_id, y from h", ", " + _SAMPLE.format(most=600, source="ord") + " select row_id, y from h", 1),
    "common_schema": sql("ord ordl hord iord", "select 1").replace(" select 1", ", v as (select f, row_number() over (order by var_pop(x) desc, f desc) as k from iord group by f), " + _SAMPLE.format(most=500, source="ord") + " select row_id, any_value(iord.y) as y, " + ", ".join(f"round(max(x) filter (f = {i}), 6) + 0.0 as {c}" for i, c in enumerate(ORD[:4])) + " from iord join h using (row_id) join q2 on q2.y = h.y where h.k <= quota group by row_id"),
    "standardise": sql("ord ordl hord iord zord", wide(ORD, "zord")),
    "standardise_apply": sql("ord ordl", "select 1").replace(" select 1", ", t as (select f, avg(x) as m, stddev_pop(x) as s from ordl where row_id % 2 = 0 group by f), z as (select row_id, y, f, (x - m) / s as x from ordl join t using (f)) " + wide(ORD, "z")),
    "centre_only": sql("doc docl", "select 1").replace(" select 1", ", z as (select row_id, y, f, x - avg(x) over (partition by f) as x from docl) " + wide(DOC, "z")),
    "transpose": sql("doc docl", "select f, list(x order by row_id) as xs from docl group by f"),
    "anova_f": sql("ord ordl fc fa anova", f"select f, {r6('score', places=4)} from anova", long="ordl"),
    "anova_prefilter": sql("emb embl fc fa anova", "select f from anova order by score desc, f desc limit 16", long="embl"),
    "anova_prefilter_fold": sql("emb embl fc fa anova", f"select f, {r6('score', places=4)} from (select * from anova order by score desc, f desc limit 20)", long="(select * from embl where row_id % 5 <> 0)"),
    "restrict_candidates": sql("ord ordl fc fa anova", "select unnest([3, 5])::int as f union all select f from (select f from anova where f not in (3, 5) order by score desc, f desc limit 2)", long="ordl"),
    "project_selected": sql("ord ordl", "select 1").replace(" select 1", ", z as (select row_id, y, f, (x - avg(x) over (partition by f)) / stddev_pop(x) over (partition by f) as x from ordl) select row_id, y, round(max(x) filter (f = 1), 6) + 0.0 as n_lines, round(max(x) filter (f = 3), 6) + 0.0 as price from z group by row_id, y"),
    "support_mask": sql("ord ordl fc fa anova", "select f, row_number() over (order by score desc, f desc) <= 3 as chosen from anova", long="ordl"),
    "partial_correlation": sql("ord ordl", """select f, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 as score from (select a.f, corr(a.x, a.y) as xy, corr(a.x, z.x) as xz, corr(a.y, z.x) as yz
      from ordl a join ordl z on z.row_id = a.row_id and z.f = 1 where a.f <> 1 group by a.f)"""),
    "label_correlation": sql("ord ordl", "select f, round(corr(x, y), 6) + 0.0 as score from ordl group by f"),
    "rank_normalise": sql("ord ordl fc fa anova", "select f, round((row_number() over (order by score, f) - 1) / (count(*) over () - 1), 6) + 0.0 as score from anova", long="ordl"),
    "mutual_information": sql("doc docl", "select 1").replace(" select 1", _MI.format(long="docl") + f" select f, {r6('score')} from mi"),
    "mutual_information_scaled": sql("usr0 usr usrl", "select 1").replace(" select 1", _MI.format(long="usrl") + " select f, round(case when max(score) over () > 0 then score / max(score) over () else score end, 6) + 0.0 as score from mi"),
    "causal_relevance": sql("ord ordl fc fa anova rel mb", "select f, round(0.3 * mb.score + 0.7 * rel.score, 6) + 0.0 as score from mb join rel using (f)", long="ordl"),
    "causal_relevance_ranked": sql("ord ordl fc fa anova rel mb", "select f, round(0.15 * a + 0.85 * b, 6) + 0.0 as score from (select f, (row_number() over (order by mb.score, f) - 1) / 5 as a, (row_number() over (order by rel.score, f) - 1) / 5 as b from mb join rel using (f))", long="ordl"),
    "correlation_pairs": sql("ord ordl mom pairs", f"select f_i, f_j, {r6('abs_corr')} from pairs", long="ordl"),
    "correlation_pairs_wide": sql("emb embl mom pairs", f"select f_i, f_j, {r6('abs_corr')} from pairs", long="embl"),
    "feature_graph": sql("ord ordl mom pairs edges", f"select f_i, f_j, {r6('weight')} from edges", long="ordl"),
    "weighted_degree": sql("ord ordl mom pairs edges degree", f"select f, {r6('score')} from degree", long="ordl"),
    "hybrid_distance": sql("ord ordl fc fa anova rel mom pairs gap hyb", f"select f_i, f_j, {r6('d_stat', 'd_causal', 'd_hybrid')} from hyb", long="ordl"),
    "composite_score": sql("ord ordl fc fa anova rel mb mom pairs edges degree", "select f, round((degree.score + 0.5 * mb.score + 0.5 * rel.score + rel.score) / 3, 6) + 0.0 as score from degree join rel using (f) join mb using (f)", long="ordl"),
    "cluster_representatives": sql("ord ordl fc fa anova clu", "select cluster, f from (select cluster, f, row_number() over (partition by cluster order by score desc, f) as k from clu join anova using (f)) where k = 1", long="ordl"),
    "ambiguous_merges": sql("ord ordl fc fa anova rel mb mer side rev", f"select step, {r6('distance', 'next_distance', 'distance_gap', 'causal_gap')}, conflicting from rev", long="ordl"),
    "merge_decisions": sql("ord ordl fc fa anova rel mb mer side rev dec", "select step, decision from dec", long="ordl"),
    "merge_veto_rate": sql("ord ordl fc fa anova rel mb mer side rev dec", "select round(coalesce(avg((not decision)::int), 0), 6) + 0.0 as veto_rate from dec", long="ordl"),
    "merge_vetoed_pairs": sql("ord ordl fc fa anova rel mb mer side rev dec vp", "select f_i, f_j from vp", long="ordl"),
    "distances_with_vetoes": sql("ord ordl fc fa anova rel mb mer side rev dec vp mom pairs gap hyb", "select hyb.f_i, hyb.f_j, round(case when vp.f_i is not null then 10 * max(d_hybrid) over () + 1 else d_hybrid end, 6) + 0.0 as d from hyb left join vp on vp.f_i = hyb.f_i and vp.f_j = hyb.f_j", long="ordl"),
    "bootstrap_resample": sql("doc", "select 1").replace(" select 1", ", r as (select row_id, row_number() over (order by row_id) - 1 as pos from doc), s as (select b::int as b, ('0x' || substr(md5(b || '-' || slot), 1, 8))::bigint % (select count(*) from doc) as pos from (select unnest(range(4)) as b), (select unnest(range((select count(*) from doc))) as slot)) select b, row_id, count(*)::int as w from s join r using (pos) group by b, row_id"),
    "bootstrap_gram": sql("ord ordl", "select 1").replace(" select 1", ", r as (select row_id, row_number() over (order by row_id) - 1 as pos from ord), s as (select b::int as b, ('0x' || substr(md5(b || '-' || slot), 1, 8))::bigint % (select count(*) from ord) as pos from (select unnest(range(3)) as b), (select unnest(range((select count(*) from ord))) as slot)) select b, f, round(count(*)::double, 4) + 0.0 as n, round(avg(x), 4) + 0.0 as mean, round(corr(x, y), 4) + 0.0 as r from s join r using (pos) join ordl using (row_id) group by b, f"),
    "jaccard_pairs": sql("sel two", "select b1, b2, round(len(list_intersect(s1, s2)) / len(list_distinct(s1 || s2)), 6) + 0.0 as jaccard from two"),
    "stability_index": sql("sel two", "select round(avg(len(list_intersect(s1, s2)) / len(list_distinct(s1 || s2))), 6) + 0.0 as stability from two"),
    "consensus_votes": sql("sel votes", f"select f, votes, {r6('share')}, rank from votes"),
    "consensus_selection": sql("sel votes", "select f from votes where rank <= 3"),
    "consensus_threshold": sql("sel votes", "select f from votes where share >= 0.5"),
    "cluster_consensus": sql("sel clu", """select distinct coalesce(rep, -c - 1)::int as f from (select c, row_number() over (order by count(*) desc, c) as k from (select distinct b, coalesce(cluster, -(f + 1)) as c
      from (select b, unnest(selected) as f from sel) left join clu using (f)) group by c) left join (select unnest([0, 1, 2]) as cluster, unnest([0, 2, 5]) as rep) on cluster = c where k <= 3"""),
    "co_association": sql("sel", "select 1").replace(" select 1", ", l as (select b, unnest(selected) as f, unnest(range(len(selected))) % 2 as c from sel) select x.f as f_i, y.f as f_j, round(count(*) / 5, 6) + 0.0 as together from l x join l y on x.b = y.b and x.c = y.c and x.f < y.f group by x.f, y.f"),
    "kuncheva_index": sql("sel two", "select b1, b2, round(case when len(s1) > 0 and len(s1) < 9 then (len(list_intersect(s1, s2)) - len(s1) * len(s1) / 9) / (len(s1) - len(s1) * len(s1) / 9) else 1 end, 6) + 0.0 as kuncheva from two"),
    "causal_plausibility": sql("sel votes", "select round(count(*) filter (f < 5) / count(*), 6) + 0.0 as plausibility, round(count(*) filter (f < 5) / 5, 6) + 0.0 as recall from votes where share >= 0.5"),
    "folds": sql("doc fold", "select row_id, y, fold from fold", wide="doc"),
    "knn_predictions": sql("emb fold near pred", "select row_id, fold, y, predicted from pred", wide="emb", dist=" + ".join(f"(a.e[{i}]::double - b.e[{i}]::double) * (a.e[{i}]::double - b.e[{i}]::double)" for i in range(1, 65))),
    "knn_accuracy": sql("doc fold near pred", "select round(avg(a), 6) + 0.0 as accuracy from (select avg((y = predicted)::int) as a from pred group by fold)", wide="doc", dist=" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DOC)),
    "balanced_accuracy": sql("doc fold near pred", "select round(avg(a), 6) + 0.0 as accuracy from (select avg(r) as a from (select fold, avg((y = predicted)::int) as r from pred group by fold, y) group by fold)", wide="doc", dist=" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DOC)),
    "trustworthiness": """with p as (select a.vec_id as i, b.vec_id as j, {few} as d1, {all} as d2
      from embeddings a join embeddings b on a.vec_id <> b.vec_id), r as (select i, row_number() over (partition by i order by d2, j) as full_rank, row_number() over (partition by i order by d1, j) as near_rank from p), n as (select count(*) as n from embeddings)
      select round(1 - 2 * sum(greatest(0, full_rank - 5)) / any_value(n * 5 * (2 * n - 16)), 6) + 0.0 as trustworthiness from r, n where near_rank <= 5""".replace("{few}", " + ".join(f"(a.embedding[{i}]::double - b.embedding[{i}]::double) * (a.embedding[{i}]::double - b.embedding[{i}]::double)" for i in (1, 3, 6))).replace("{all}", " + ".join(f"(a.embedding[{i}]::double - b.embedding[{i}]::double) * (a.embedding[{i}]::double - b.embedding[{i}]::double)" for i in range(1, 65))),
    "smallest_k_within": sql("res", "select 1").replace(" select 1", ", c as (select (seed * 4 + length(method))::int as k, avg(accuracy) as a from res group by 1) select min(k) as k from c where a >= (select max(a) from c) - 0.02"),
    "fold_summary": sql("res fk fs", f"select k, {r6('mean_perf', 'se_perf', 'redundancy', 'stability')} from fs"),
    "choose_k": sql("res fk fs", "select 1").replace(" select 1", """, b as (select mean_perf - se_perf as t from fs order by mean_perf desc, k limit 1),
      e as (select *, mean_perf >= t as eligible, mean_perf >= t and stability >= 0.6 as stable from fs, b),
      m as (select *, (mean_perf - min(mean_perf) over ()) / (max(mean_perf) over () - min(mean_perf) over ()) + 0.2 * (stability - min(stability) over ()) / (max(stability) over () - min(stability) over ())
        - 0.1 * (redundancy - min(redundancy) over ()) / (max(redundancy) over () - min(redundancy) over ()) - 0.05 * k / max(k) over () as mix, bool_or(stable) over () as any_stable, max(k) over () as top from e)
      select k, """ + r6("mean_perf", "se_perf", "stability", "redundancy") + """, eligible, stable, row_number() over (order by case when any_stable then case when stable then redundancy + 0.02 * k / top end else -mix end nulls last, k) = 1 as chosen from m"""),
    "min_max": sql("res means", "select method, " + ", ".join(f"round(case when max({m}) over () - min({m}) over () >= 1e-12 then ({m} - min({m}) over ()) / (max({m}) over () - min({m}) over ()) else 0 end, 6) + 0.0 as {m}" for m in METRICS) + " from means"),
    "friedman_statistic": sql("res dm", """select round((12 * sum(s * s) / (any_value(n) * count(*) * (count(*) + 1)) - 3 * any_value(n) * (count(*) + 1)) / (1 - sum(t) / (any_value(n) * (count(*) * count(*) * count(*) - count(*)))), 6) + 0.0 as statistic, (count(*) - 1)::int as dof
      from (select method, sum(r) as s, sum(t) as t, count(*) as n from (select dataset, method, rank() over (partition by dataset order by accuracy) + (count(*) over (partition by dataset, accuracy) - 1) / 2 as r,
        count(*) over (partition by dataset, accuracy) * count(*) over (partition by dataset, accuracy) - 1 as t from dm) group by method)"""),
    "wilcoxon_ranks": sql("res dm", """, d as (select b.method, p.accuracy - b.accuracy as d, round(abs(p.accuracy - b.accuracy), 12) as s from dm b join dm p on p.dataset = b.dataset and p.method = 'Proposed' where b.method <> 'Proposed'),
      r as (select method, d, rank() over (partition by method order by s) + (count(*) over (partition by method, s) - 1) / 2 as r from d where s > 0)
      select method, round(delta, 6) + 0.0 as delta, coalesce(plus, 0)::double as plus, coalesce(minus, 0)::double as minus, coalesce(n, 0) as n from (select method, avg(d) as delta from d group by method)
      left join (select method, sum(r) filter (d > 0) as plus, sum(r) filter (d < 0) as minus, count(*) as n from r group by method) using (method)""").replace(") , d as", "), d as"),
    "mean_by_method": sql("res means", f"select method, {r6(*METRICS)} from means"),
    "mean_by_dataset_method": sql("res dm", f"select dataset, method, {r6(*METRICS)} from dm"),
    "mean_std_text": sql("res", "select method, " + ", ".join(f"case when coalesce(stddev_samp({m}), 0) > 0 then printf('%.3f ± %.3f', avg({m}), stddev_samp({m})) else printf('%.3f', avg({m})) end as {m}" for m in METRICS) + " from res group by method"),
    "average_ranks": sql("res dm", "select method, " + ", ".join(f"round(avg({m}), 6) + 0.0 as {m}" for m in METRICS) + " from (select dataset, method, " + ", ".join(f"rank() over (partition by dataset order by {m} {'asc' if m == 'runtime_s' else 'desc'}) + (count(*) over (partition by dataset, {m}) - 1) / 2 as {m}" for m in METRICS) + " from dm) group by method"),
    "pivot_accuracy": sql("res", "select dataset, " + ", ".join(f"round(\"{n}\", 6) + 0.0 as \"{n}\"" for n in METHODS) + f" from ({pivoted('accuracy', 'dataset', 'method', METHODS)})"),
    "pivot_plausibility": sql("res", "select method, " + ", ".join(f"round(\"{n}\", 6) + 0.0 as \"{n}\"" for n in PRIORITIES) + ", round(list_avg([" + ", ".join(f'"{n}"' for n in PRIORITIES) + "]), 6) + 0.0 as mean" + f" from ({pivoted('causal_plausibility', 'method', 'dataset', PRIORITIES)})"),
    "pareto_frontier": sql("res means", f"select method, {r6('accuracy', 'runtime_s')} from means m where not exists (select 1 from means o where o.method <> m.method and o.accuracy >= m.accuracy and o.runtime_s <= m.runtime_s and (o.accuracy > m.accuracy or o.runtime_s < m.runtime_s))"),
    "best_per_column": sql("res means", "select method, " + ", ".join(f"{m} = {'min' if m == 'runtime_s' else 'max'}({m}) over () as {m}" for m in METRICS) + " from means"),
    "best_per_row": sql("res", "select dataset, " + ", ".join(f"coalesce(\"{n}\" = greatest({', '.join(chr(34) + x + chr(34) for x in METHODS)}), false) as \"{n}\"" for n in METHODS) + f" from ({pivoted('accuracy', 'dataset', 'method', METHODS)})"),
    "best_method": sql("res means mo", "select metric, method, round(value, 6) + 0.0 as value from (select metric, method, value, row_number() over (partition by metric order by case when metric = 'runtime_s' then value else -value end, position) as k from (" + " union all ".join(f"select '{m}' as metric, method, position, {m} as value from means join mo using (method)" for m in METRICS) + ")) where k = 1"),
    "first_k": sql("res", "select dataset, min(k) as k from res group by dataset"),
    "report_shape": sql("res", "select count(distinct dataset) as n_datasets, count(distinct method) as n_methods, count(distinct seed) as n_seeds, count(causal_plausibility) as n_truth from res"),
    "method_order": sql("res means mo", "select method, position, " + ", ".join(f"round(case when method <> 'VAE' then {m} end, 6) + 0.0 as {m}" for m in METRICS) + " from mo left join means using (method)"),
    "mean_row": sql("res", "select 1").replace(" select 1", f", w as ({pivoted('stability', 'dataset', 'method', METHODS)}) select dataset, " + ", ".join(f"round(\"{n}\", 3) as \"{n}\"" for n in METHODS) + " from w union all select 'Mean', " + ", ".join(f"round(avg(\"{n}\"), 3)" for n in METHODS) + " from w"),
    "most_stable": sql("res means mo", f"select method, {r6('stability')} from means join mo using (method) where method in ('PCA', 'LASSO', 'mRMR', 'Random') order by means.stability desc, position limit 1"),
    "stage_preview": sql("ord", f"select row_id, y, {', '.join(f'round({c}, 3) as {c}' for c in ORD)} from ord order by row_id limit 5"),
    "screening_flagship": sql("ord ordl hord iord zord fc fa anova mom pairs edges degree", "select f, round(anova.score, 4) + 0.0 as score, round(degree.score, 4) + 0.0 as centrality from anova join degree using (f) order by anova.score desc, f desc limit 3", long="zord"),
}
ORACLES["partial_correlation_gram"] = ORACLES["partial_correlation"]


def _greedy(beta: float = 1.0, eta: float = 1.0, gamma: float = 0.0, steps: int = 4) -> str:
    """A greedy order, a named part for each step: the best of the features that aren't chosen yet."""
    own = ", rc as (select f, least(abs(corr(x, y)), 0.999999) as s from ordl group by f), cs as (select f_i as a, f_j as b, abs_corr as c from pairs union all select f_j, f_i, abs_corr from pairs)"
    out = [own, "ch0 as (select 0 as step, (select f from rc order by s desc, f limit 1) as f)"]
    for k in range(1, steps):
        fresh = f" + {gamma} * (max((ga.cluster = gb.cluster)::int) = 0)::int" if gamma else ""
        groups = " join clu ga on ga.f = rc.f join clu gb on gb.f = ch.f" if gamma else ""
        score = f"any_value(s) - {beta} * ({eta} * max(c) + {1 - eta} * avg(c)){fresh}"
        best = f"(select rc.f from rc join cs on cs.a = rc.f join ch{k - 1} ch on ch.f = cs.b{groups} where rc.f not in (select f from ch{k - 1}) group by rc.f order by {score} desc, rc.f limit 1)"
        out.append(f"ch{k} as (select * from ch{k - 1} union all select {k}, {best})")
    return sql("ord ordl mom pairs" + " clu" * bool(gamma), "", long="ordl") + ", ".join(out) + f" select step::int as step, f::int as f from ch{steps - 1}"


def linkage_sql(select: str, p: int = 6) -> str:
    """Average linkage, two named parts for each merge: the nearest clusters (known by their least member) and the members after it."""
    out = [", ds as (select f_i as a, f_j as b, d_hybrid as d from hyb union all select f_j, f_i, d_hybrid from hyb)", f"cl0 as (select unnest(range({p}))::int as f, unnest(range({p}))::int as c)"]
    for k in range(p - 1):
        out.append(f"mg{k} as (select x.c as i, y.c as j, avg(d) as distance from cl{k} x join cl{k} y on x.c < y.c join ds on ds.a = x.f and ds.b = y.f group by 1, 2 order by 3, 1, 2 limit 1)")
        out.append(f"cl{k + 1} as (select f, case when c = (select j from mg{k}) then (select i from mg{k}) else c end as c from cl{k})")
    return sql("ord ordl fc fa anova rel mom pairs gap hyb", "", long="ordl") + ", ".join(out) + " " + select


_LINES = "select (row_number() over (order by part, pos) - 1)::int as line, text from ({}) order by 1"
_TEX = r"""
select 0 as part, 0 as pos, '\begin{table}[t]' as text union all select 1, 0, '\centering' union all select 2, 0, '\caption{Mean metrics across datasets.}'
union all select 3, 0, '\begin{tabular}{lcccc}' union all select 4, 0, '\toprule' union all select 5, 0, 'Method & accuracy & stability & trustworthiness & runtime s \\' union all select 6, 0, '\midrule'
union all select 7, position, method || BODY || ' \\' from mo join means using (method) join sd using (method)
union all select 8, 0, '\bottomrule' union all select 9, 0, '\end{tabular}' union all select 10, 0, '\end{table}'"""


def _tex() -> str:
    cells = []
    for m in METRICS:
        cell = f"printf('%.3f', {m}) || case when coalesce(sd_{m}, 0) > 0 then ' $\\pm$ ' || printf('%.3f', sd_{m}) else '' end"
        cells.append(f"' & ' || case when {m} = (select {'min' if m == 'runtime_s' else 'max'}({m}) from means) then '\\textbf{{' || {cell} || '}}' else {cell} end")
    spread = ", sd as (select method, " + ", ".join(f"stddev_samp({m}) as sd_{m}" for m in METRICS) + " from res group by method) "
    return sql("res means mo", "") + spread + _LINES.format(_TEX.replace("BODY", " || ".join(cells)))


def _conditional() -> str:
    """|partial correlation| of each feature with the label given all others: these are swept out of the correlation matrix in turn."""
    out = [
        ", al as (select row_id, f, x from ordl union all select row_id, 6, y from ord)",
        "sw0 as (select t, a.f as i, b.f as j, corr(a.x, b.x) as v from al a join al b using (row_id) cross join (select unnest(range(6)) as t) group by t, a.f, b.f)",
    ]
    for k in range(6):
        out.append(f"sw{k + 1} as (select m.t, m.i, m.j, case when m.t = {k} then m.v else m.v - r.v * c.v / p.v end as v from sw{k} m join sw{k} r on r.t = m.t and r.i = m.i and r.j = {k} join sw{k} c on c.t = m.t and c.i = {k} and c.j = m.j join sw{k} p on p.t = m.t and p.i = {k} and p.j = {k})")
    last = "select t as f, abs(any_value(v) filter (i = t and j = 6)) / sqrt(any_value(v) filter (i = t and j = t) * any_value(v) filter (i = 6 and j = 6)) as s from sw6 group by t"
    return sql("ord ordl", "") + ", ".join(out) + f" select f::int as f, round(s / max(s) over (), 6) + 0.0 as score from ({last})"


#: Simpson's rule from 0 to z for the normal density, in 2000 steps.
_NORMAL = "list_sum([case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-power(z * i / 2000, 2) / 2) for i in range(2001)]) * z / 6000 / sqrt(2 * pi())"
_FISHER = sql("ord ordl", "") + f""", al as (select row_id, f, x from ordl union all select row_id, 6, y from ord),
  cc as (select a.f as i, b.f as j, corr(a.x, b.x) as r, count(*) as n from al a join al b using (row_id) group by 1, 2),
  pr as (select iy.i as f, iy.n, (iy.r - i0.r * y0.r) / sqrt((1 - i0.r * i0.r) * (1 - y0.r * y0.r)) as r from cc iy join cc i0 on i0.i = iy.i and i0.j = 0 join cc y0 on y0.i = 6 and y0.j = 0 where iy.j = 6 and iy.i between 1 and 5),
  zz as (select f, least(sqrt(n - 4) * abs(atanh(r)), 9.0) as z from pr)
  select f, greatest(round(1 - 2 * {_NORMAL}, 6), 0) + 0.0 as p from zz"""

ORACLES |= {
    "conditional_relevance": _conditional(),
    "fisher_z_test": _FISHER,
    "greedy_selection": _greedy(),
    "mrmr_kernel": _greedy(1.0, 0.0),
    "greedy_grouped_selection": _greedy(1.0, 0.7, 0.3),
    "linkage_merges": linkage_sql(" union all ".join(f"select {k} as step, (select list(f order by f) from cl{k} where c = i) as \"left\", (select list(f order by f) from cl{k} where c = j) as \"right\", round(distance, 6) + 0.0 as distance from mg{k}" for k in range(5))),
    "linkage_labels": linkage_sql("select f, (dense_rank() over (order by c) - 1)::int as cluster from cl3"),
    "markdown_report": sql("res means mo", "") + _LINES.format(
        f"select 0 as part, 0 as pos, '| method | {' | '.join(METRICS)} |' as text union all select 1, 0, '| --- | --- | --- | --- | --- |' union all select 2, position, '| ' || method || ' | ' || "
        + " || ' | ' || ".join(f"printf('%.3f', {m})" for m in METRICS) + " || ' |' from mo join means using (method)"
    ),
    "latex_table": _tex(),
    # Exact: all sign patterns of the ranks of five differences.
    "wilcoxon_test": sql("res dm", "").rstrip() + """, d as (select b.method, p.accuracy - b.accuracy as d from dm b join dm p on p.dataset = b.dataset and p.method = 'Proposed' where b.method <> 'Proposed'),
      r as (select method, d, rank() over (partition by method order by round(abs(d), 12)) as r from d), n as (select count(distinct dataset) as n from dm),
      w as (select method, least(coalesce(sum(r) filter (d > 0), 0), coalesce(sum(r) filter (d < 0), 0)) as low from r group by method),
      s as (select p, sum(((p >> (i - 1)) & 1) * i) as s from (select unnest(range((1 << n::int)::bigint)) as p from n) cross join (select unnest(range(1, n::bigint + 1)) as i from n) group by p)
      select method, round(least(1, 2 * count(*) filter (s <= low) / (1 << any_value(n)::int)), 6) + 0.0 as p from w cross join s cross join n group by method""",
    "stage_descriptions": sql("ord", "") + """select *, (select count(*) from ord) as n_rows, 6 as n_features from (values
      ('prepare', 'Fill gaps with medians and bring every feature to mean 0 and deviation 1.'),
      ('relevance', 'Find the label''s Markov blanket by conditional independence tests and blend it with a predictive score.'),
      ('graph', 'Link features whose absolute correlation reaches the threshold.'),
      ('distance', 'Mix one less the correlation with the gap in relevance.'),
      ('clusters', 'Join nearest clusters by average linkage until k are left; a reviewer may veto doubtful joins.'),
      ('prototypes', 'Take one feature of each cluster, or go greedily by relevance less redundancy.'),
      ('consensus', 'Repeat on resamples, vote, and measure how far the selections agree.')) t(stage, detail)""",
    # numpy's generator with seed 42 draws these three of six.
    "baseline_random": "select unnest([0, 3, 5])::int as f",
}
