"""Queries of continuous labels, exact resamples and blocks, DuckDB SQL for them, and for generated tables."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from sieveline.operators import baselines, causal, prepare, resample, stats
from sieveline.operators.continuous import lasso
from sieveline.operators.forest import Shape, forest_importances
from sieveline.sources.results import manifest
from sieveline.sources.synthetic import shape_of
from sieveline.sources.tables import balances_frame, documents_frame, orders_frame, prices_frame

from .config import Config, soft
from .oracles import ORACLES, ORD, PARTS, linkage_sql, r6, sql
from .queries import listed, query, rounded
from .selector import Selector


@query
def information_of_prices(spark, d):
    """How much an order's lines tell about its price: every order, by nearest neighbours in two dimensions."""
    return rounded(causal.mutual_information(prices_frame(spark, d)))


@query
def information_of_balances(spark, d):
    return rounded(causal.mutual_information(balances_frame(spark, d)))


@query
def lasso_of_prices(spark, d):
    """Coefficients of the lasso of penalty 1000 on standardised numbers of lines and taxes."""
    z = prepare.Standardiser().fit_transform(prices_frame(spark, d).take([0, 4]).stored())
    g = stats.gram(z)
    return rounded(causal.vector_frame(z, lasso(g, 1000.0)), 4)


@query
def lasso_selection_of_prices(spark, d):
    return listed(spark, baselines.build_baseline("LASSO", 3).fit(prices_frame(spark, d)).selected_features_)


@query
def forest_of_prices(spark, d):
    frame = prices_frame(spark, d)
    return rounded(causal.vector_frame(frame, causal.forest_relevance(frame)), 4)


@query
def forest_of_resamples(spark, d):
    """Importances in the whole table (b = -1) and in three resamples, from one scan a level."""
    frame = documents_frame(spark, d)
    found = forest_importances(frame, 3, shape=Shape(trees=10, depth=5))
    return rounded(spark.createDataFrame([(b, f, float(v)) for b, x in found.items() for f, v in enumerate(x)], "b int, f int, score double"))


@query
def selection_of_refits(spark, d):
    """Soft selection whose importances are those of each resample."""
    m = Selector(soft(2, 4, 4), refit_rows=True).fit(documents_frame(spark, d))
    return listed(spark, m.selected_features_)


@query
def selection_of_prices(spark, d):
    """A whole selection for a continuous label, by information."""
    m = Selector(Config(n_representatives=2, n_bootstrap=5)).fit(prices_frame(spark, d))
    rows = [(i, float(m.mb_mask_[i]), float(m.predictive_[i]), i in m.selected_features_) for i in range(m.p_)]
    return rounded(spark.createDataFrame(rows, "f int, mb double, predictive double, chosen boolean"))


# --- resamples and blocks ------------------------------------------------------------------------


@query
def exact_bootstrap(spark, d):
    """The draws of each of five resamples, which are as many as rows, and the share of rows that they leave out."""
    frame = documents_frame(spark, d)
    w = resample.exact_resample(frame, 5)
    n = frame.df.agg(F.count(F.lit(1)).alias("n"))
    found = w.groupBy("b").agg(F.sum("w").alias("draws"), F.count(F.lit(1)).alias("met"), F.countDistinct("row_id").alias("rows"))
    return found.crossJoin(n).select("b", "draws", (F.col("met") == F.col("rows")).alias("once"), (F.abs(1 - F.col("rows") / F.col("n") - 0.3679) < 0.1).alias("usual_share"))


@query
def exact_bootstrap_selection(spark, d):
    m = Selector(Config(n_representatives=3, n_bootstrap=10, conditional_relevance=True), exact=True).fit(orders_frame(spark, d))
    return listed(spark, m.selected_features_)


@query
def transpose_blocks(spark, d):
    return prepare.transpose_blocks(orders_frame(spark, d), 1000)


_BALANCES = """
with c as (
  select c_custkey as id, c_acctbal as y, count(o_orderkey)::double as orders, max(o_totalprice) as dearest, c_nationkey::double as nation
  from customer left join orders on o_custkey = c_custkey group by all),
t as (select id, y, unnest(range(3))::int as f, unnest([orders, dearest, nation]) as x from c),
u as (select * from t where x is not null and y is not null),
s as (select f, count(*) as n, case when stddev_pop(x) > 0 then stddev_pop(x) else 1 end as sx, case when stddev_pop(y) > 0 then stddev_pop(y) else 1 end as sy from u group by f),
p as (
  select a.f, a.id, a.x, a.y, abs(a.x - b.x) as dx, abs(a.y - b.y) as dy, sx, sy, n, least(3, n - 1) as k
  from u a join u b on a.f = b.f and a.id <> b.id join s on s.f = a.f),
q as (select *, row_number() over (partition by f, id order by greatest(dx * sy, dy * sx)) as place from p),
r as (
  select f, id, x, y, n, k, case when dx * sy >= dy * sx then dx else dy * sx / sy end as rx, case when dx * sy >= dy * sx then dx * sy / sx else dy end as ry
  from q where place = k),
m as (
  select r.f, r.id, any_value(r.n) as n, any_value(r.k) as k,
         count(*) filter (case when rx > 0 then u.x > r.x - rx and u.x < r.x + rx else u.x = r.x end) as mx,
         count(*) filter (case when ry > 0 then u.y > r.y - ry and u.y < r.y + ry else u.y = r.y end) as my
  from r join u on u.f = r.f group by r.f, r.id),
h as (select i, coalesce(sum(1.0 / (i - 1)) filter (i > 1) over (order by i), 0)::double as h from (select unnest(range(1, 200001)) as i))
select m.f, round(greatest(0, any_value(hn.h) + any_value(hk.h) - avg(hx.h) - avg(hy.h)), 6) + 0.0 as score
from m join h hn on hn.i = m.n join h hk on hk.i = m.k join h hx on hx.i = mx join h hy on hy.i = my group by m.f
"""

#: Two features: the best of the nine choices of which are zero and of signs.
_LASSO = """
with l as (select l_orderkey, count(*)::double as n_lines, avg(l_tax) as tax from lineitem group by l_orderkey),
a as (
  select (n_lines - avg(n_lines) over ()) / stddev_pop(n_lines) over () as u, (tax - avg(tax) over ()) / stddev_pop(tax) over () as v, o_totalprice - avg(o_totalprice) over () as y
  from orders join l on l_orderkey = o_orderkey),
c as (select avg(u * u) as uu, avg(u * v) as uv, avg(v * v) as vv, avg(u * y) as uy, avg(v * y) as vy from a),
s as (select i, j from (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j)),
w as (
  select c.*, case when i = 0 then 0 when j = 0 then (uy - 1000.0 * i) / uu else ((uy - 1000.0 * i) * vv - (vy - 1000.0 * j) * uv) / (uu * vv - uv * uv) end as a,
         case when j = 0 then 0 when i = 0 then (vy - 1000.0 * j) / vv else ((vy - 1000.0 * j) * uu - (uy - 1000.0 * i) * uv) / (uu * vv - uv * uv) end as b
  from c, s),
o as (select a, b, (a * a * uu + 2 * a * b * uv + b * b * vv) / 2 - a * uy - b * vy + 1000.0 * (abs(a) + abs(b)) as cost from w),
best as (select arg_min([a, b], cost) as w from o)
select unnest([0, 1])::int as f, unnest([round(w[1], 4) + 0.0, round(w[2], 4) + 0.0]) as score from best
"""



# --- generated tables --------------------------------------------------------------------------


def _normal(seed: int, stream: int) -> str:
    u = [f"((('0x' || substr(md5('{seed}:{stream}:{k}:' || id), 1, 13))::bigint::double + 0.5) * pow(2.0, -52))" for k in (0, 1)]
    return f"(sqrt(-2 * ln({u[0]})) * cos({2 * math.pi!r} * {u[1]}))"


def _synthetic(p: int, informative: int, redundant: int, seed: int) -> str:
    corners, mixes = shape_of(informative, 2, redundant, seed)
    drivers = ", ".join(f"{_normal(seed, i)} + [{corners[0, i]}, {corners[1, i]}][y + 1] as x{i}" for i in range(informative))
    mixed = ", ".join(f"{' + '.join(f'x{i} * ({w!r})' for i, w in enumerate(map(float, m)))} as x{informative + j}" for j, m in enumerate(mixes))
    noise = ", ".join(f"{_normal(seed, i)} as x{i}" for i in range(informative + redundant, p))
    label = f"floor((('0x' || substr(md5('{seed}:-1:0:' || id), 1, 13))::bigint::double + 0.5) * pow(2.0, -52) * 2)::int as y"
    return f"""with k as (select c_custkey as id from customer), l as (select id, {label} from k), d as (select id, y, {drivers} from l),
      a as (select *, {mixed}, {noise} from d) select id as row_id, y, {r6(*[f"x{i}" for i in range(p)])} from a"""


def _structural(drivers: int = 5, noise: int = 10, seed: int = 0) -> str:
    pairs = list(combinations(range(drivers), 2))
    causes = ", ".join(f"{_normal(seed, i)} as driver_{i}" for i in range(drivers))
    effect = " + ".join([f"0.4 * {_normal(seed, -1)}", *(f"driver_{i}" for i in range(drivers))])
    rest = [f"driver_{i} + driver_{j} + 0.25 * {_normal(seed, drivers + at)} as spurious_{i}{j}" for at, (i, j) in enumerate(pairs)]
    rest += [f"{_normal(seed, drivers + len(pairs) + i)} as noise_{i}" for i in range(noise)]
    names = [*(f"driver_{i}" for i in range(drivers)), *(f"spurious_{i}{j}" for i, j in pairs), *(f"noise_{i}" for i in range(noise))]
    return f"""with k as (select c_custkey as id from customer), d as (select id, {causes} from k), a as (select *, {effect} as effect, {", ".join(rest)} from d)
      select id as row_id, (effect > (select median(effect) from a))::int as y, {r6(*names)} from a"""


def _manifest() -> str:
    text = manifest(Config(), dataset="orders", features=ORD, rows=12345).replace("'", "''")
    return sql("ord", "") + f"select replace('{text}', '12345', (select count(*) from ord)::varchar) as manifest"


# --- reports, components and refits --------------------------------------------------------------


def _significance() -> str:
    """The statistic and tests of their own queries, as text; the tail of chi-squared for an odd number of degrees by its series."""
    tail = "2 / sqrt(pi()) * list_sum([case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-power(sqrt(h) + i * 0.004, 2)) for i in range(2001)]) * 0.004 / 3"
    series = "list_sum([power(h, i - 0.5) / gamma(i + 0.5) for i in range(1, (dof // 2 + 1)::bigint)])"
    means = sql("res dm", "select b.method, avg(p.accuracy - b.accuracy) as delta from dm b join dm p on p.dataset = b.dataset and p.method = 'Proposed' where b.method <> 'Proposed' group by b.method")
    return f"""with f as ({ORACLES["friedman_statistic"]}), w as ({ORACLES["wilcoxon_test"]}), m as ({means}), o as ({sql("mo", "select * from mo")}),
      c as (select statistic, dof, statistic / 2 as h from f), t as (select statistic, {tail} + exp(-h) * {series} as p from c)
      select 0 as line, printf('Friedman chi-squared = %.3f, p = %.4g', statistic, p) as text from t union all select 1, ''
      union all select (1 + row_number() over (order by position))::int, printf('%s: mean difference %+.4f, Wilcoxon p = %.4g', method, delta, w.p) from m join w using (method) join o using (method)"""


def _components(k: int) -> str:
    """The k leading eigenvectors of the orders' correlations, one after the other by powers of what the earlier ones leave."""
    out = [", cc as (select a.f as i, b.f as j, corr(a.x, b.x) as v from ordl a join ordl b using (row_id) group by 1, 2)", "m0 as (select list(r order by i) as m from (select i, list(v order by j) as r from cc group by i))"]
    for c in range(k):
        step = "[list_dot_product(r, v) for r in m]"
        out.append(f"p{c}(n, m, v) as (select 0, m, [1.0, 0.7, -0.4, 0.2, 0.9, -0.6]::double[] from m{c} union all select n + 1, m, [x / sqrt(list_dot_product(w, w)) for x in w] from (select n, m, {step} as w from p{c} where n < 6000))")
        out.append(f"v{c} as (select v, list_dot_product(v, {step}) as l, m from p{c} where n = 6000)")
        out.append(f"m{c + 1} as (select [[m[i][j] - l * v[i] * v[j] for j in range(1, 7)] for i in range(1, 7)] as m from v{c})")
    return sql("ord ordl", "").replace("with ord", "with recursive ord", 1) + ", ".join(out)


_PCA = _components(3) + " select f from (select unnest(range(6))::int as f, unnest([" + ", ".join(f"abs(v0.v[{i}]) + abs(v1.v[{i}]) + abs(v2.v[{i}])" for i in range(1, 7)) + "]) as s from v0, v1, v2) order by s desc, f desc limit 3"
_PROJECTED = _components(2) + ", z as (select row_id, f, (x - avg(x) over (partition by f)) / stddev_pop(x) over (partition by f) as x from ordl), r as (select row_id, list(x order by f) as x from z group by row_id) select row_id, round(abs(list_dot_product(x, v0.v)), 4) + 0.0 as component_0, round(abs(list_dot_product(x, v1.v)), 4) + 0.0 as component_1 from r, v0, v1"

#: F of the rows that each of two resamples has drawn.
_RUNS = sql("doc docl", "").rstrip() + """, r as (select row_id, row_number() over (order by row_id) - 1 as pos from doc),
  s as (select distinct b::int as b, ('0x' || substr(md5(b || '-' || slot), 1, 8))::bigint % (select count(*) from doc) as pos from (select unnest(range(2)) as b), (select unnest(range((select count(*) from doc))) as slot)),
  l as (select b, f, y, x - avg(x) over (partition by b, f) as x from s join r using (pos) join docl using (row_id)),
  c as (select b, f, y, count(*)::double as n, sum(x) as s, sum(x * x) as q from l group by b, f, y),
  a as (select b, f, count(*) as k, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as g from c group by b, f),
  o as (select b, f, row_number() over (partition by b order by ((g - s * s / n) / (k - 1)) / ((q - g) / (n - k)) desc, f desc) as place from a)
  select b, list(f order by f) as selected from o where place <= 2 group by b"""



def _blanket(base: str = "ord", long: str = "ordl", p: int = 6) -> str:
    """Growth and shrinkage of the blanket of a table of p features, a few named parts a step; given features are swept out of the correlations.

    A test's p is below 0.05 where z is above its quantile; p saturates at 0, so strengths beyond 8.29 are equal.
    """

    def sweep(m: str, g: str) -> str:
        return f"case when {g} is null then {m} else [[{m}[a][b] - {m}[a][{g}] * {m}[{g}][b] / {m}[{g}][{g}] for b in range(1, {p + 2})] for a in range(1, {p + 2})] end"

    def z(i: str, given: str) -> str:
        return f"sqrt(n - {given} - 3) * abs(atanh(greatest(least(m3[{i}][{p + 1}] / sqrt(m3[{i}][{i}] * m3[{p + 1}][{p + 1}]), 0.999999), -0.999999)))"

    enough = "1.959963984540054"
    out = [
        f", al as (select row_id, f + 1 as f, x from {long} union all select row_id, {p + 1}, y from {base})",
        "cc as (select a.f as i, b.f as j, corr(a.x, b.x) as v from al a join al b using (row_id) group by 1, 2)",
        f"g0 as (select []::bigint[] as s, (select count(*) from {base}) as n, (select list(r order by i) from (select i, list(v order by j) as r from cc group by i)) as m)",
    ]
    for k in range(p):
        out += [f"a{k} as (select *, {sweep('m', 's[-1]')} as m1 from g{k})", f"b{k} as (select *, {sweep('m1', 's[-2]')} as m2 from a{k})", f"c{k} as (select *, {sweep('m2', 's[-3]')} as m3 from b{k})"]
        out.append(f"d{k} as (select s, n, m, list_max([{{'z': case when list_contains(s, i) then -1 else least({z('i', 'least(len(s), 3)')}, 8.2923) end, 'f': -i}} for i in range(1, {p + 1})]) as best from c{k})")
        out.append(f"g{k + 1} as (select case when best.z > {enough} then list_append(s, -best.f) else s end as s, n, m from d{k})")
    out.append(f"s0 as (select * from g{p})")
    for k in range(p):
        out.append(f"u{k} as (select *, list_filter(s, lambda x: x <> s[p])[1:3] as o from (select s, n, m, unnest(range(1, len(s) + 1)) as p from s{k}))")
        out += [f"v{k} as (select *, {sweep('m', 'o[1]')} as m1 from u{k})", f"w{k} as (select *, {sweep('m1', 'o[2]')} as m2 from v{k})", f"x{k} as (select *, {sweep('m2', 'o[3]')} as m3 from w{k})"]
        out.append(f"s{k + 1} as (select case when p is null then s else list_filter(s, lambda x: x <> s[p]) end as s, n, m from s{k}, (select min(p) as p from x{k} where {z('s[p]', 'len(o)')} <= {enough}))")
    return sql(f"{base} {long}", "") + ", ".join(out) + f" select (f - 1)::int as f from (select unnest(s) as f from s{p})"


def _modes() -> str:
    """Three features by each way of choosing: the best of each cluster by three scores, and the greedy order of the predictive one."""
    of = f"""mb as (select r.f, count(b.f)::double as score from (select unnest(range(6))::int as f) r left join ({_blanket()}) b on b.f = r.f group by r.f),
      pred as ({ORACLES["conditional_relevance"]}), rel as (select f, 0.5 * mb.score + 0.5 * pred.score as score from mb join pred using (f))"""
    steps = ["ch0 as (select (select f from pred order by score desc, f limit 1) as f)"]
    for k in (1, 2):
        best = f"select pred.f from pred join cs on cs.a = pred.f join ch{k - 1} h on h.f = cs.b where pred.f not in (select f from ch{k - 1}) group by pred.f order by any_value(score) - max(c) desc, pred.f limit 1"
        steps.append(f"ch{k} as (select * from ch{k - 1} union all select * from ({best}))")
    scores = "select 'composite' as mode, f, (degree.score + rel.score + pred.score) / 3 as score from degree join rel using (f) join pred using (f) union all select 'relevance', f, score from rel union all select 'predictive', f, score from pred"
    select = f""", edges as ({PARTS["edges"]}), degree as ({PARTS["degree"]}), cs as (select f_i as a, f_j as b, abs_corr as c from pairs union all select f_j, f_i, abs_corr from pairs), {", ".join(steps)},
      o as (select mode, f, row_number() over (partition by mode, c order by score desc, f) as place from ({scores}) join cl3 using (f))
      select mode, f from o where place = 1 union all select 'greedy', f from ch2"""
    return linkage_sql(select).replace(f"rel as ({PARTS['rel']})", of)


def _analysis() -> str:
    """Blanket, information over its maximum, and the mean of both, of the documents' features."""
    return f"""with mb as ({_blanket("doc", "docl", 4)}), mi as ({ORACLES["mutual_information"].replace(r6("score"), "score")}), r as (select f, case when f in (select f from mb) then 1.0 else 0.0 end::double as mb, score / max(score) over () as predictive from mi)
      select f, mb, round(predictive, 6) + 0.0 as predictive, round(0.5 * mb + 0.5 * predictive, 6) + 0.0 as relevance from r"""


ORACLES |= {
    "causal_analysis": _analysis(),
    "markov_blanket": _blanket(),
    "prototype_modes": _modes(),
    "significance_report": _significance(),
    "baseline_pca": _PCA,
    "pca_projection": _PROJECTED,
    "bootstrap_runs": _RUNS,
    "exact_bootstrap": sql("doc", "select unnest([0, 1, 2, 3, 4])::int as b, count(*)::bigint as draws, true as once, true as usual_share from doc"),
    "transpose_blocks": sql("ord ordl", "select f, block, list(x order by row_id) as xs from (select f, row_id, x, (row_number() over (partition by f order by row_id) - 1) // 1000 as block from ordl) group by f, block"),
    "information_of_balances": _BALANCES,
    "lasso_of_prices": _LASSO,
    "synthetic_source": _synthetic(20, 5, 5, 42),
    "madelon_like_source": _synthetic(50, 5, 15, 3),
    "structural_source": _structural(),
    "config_manifest": _manifest(),
}
