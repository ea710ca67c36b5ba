"""The registered queries of the feature-selection operators, over the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.operators import baselines, causal, consensus, evaluate, prepare, report, stats, structure
from sieveline.session import shared_dir, ship
from sieveline.sources import results as R
from sieveline.sources import synthetic
from sieveline.sources.tables import CATALOGUE, documents_frame, embeddings_frame, first_that_loads, frame_of, load_csv, orders_frame, users_frame

from . import experiments as X
from .config import STAGES, Config, soft, strict
from .selector import Selector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places, as the last step, so that engines that add in another order agree; no negative zero."""
    return df.select(*[(F.round(c.name, places) + 0.0).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(f"`{c.name}`") for c in df.schema.fields])


def holes(frame: FeatureFrame, every: int = 17) -> FeatureFrame:
    """Every 17th cell, along the diagonals, missing."""
    x = [F.when(F.col("row_id") % every != i % every, F.col(f"`{c}`")).alias(c) for i, c in enumerate(frame.features)]
    return frame.with_df(frame.wide().select("row_id", "y", *x))


def listed(spark: SparkSession, features: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(f),) for f in features], "f int")


# --- sources and sinks ---------------------------------------------------------------------------------


@query
def csv_source(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "?").otherwise(F.col("s_acctbal").cast("string")).alias("balance"), F.col("n_name").alias("nation"), F.concat(F.lit("region "), "n_regionkey").alias("region"))
    path = f"{shared_dir(spark)}/sieveline/{uuid.uuid4().hex}-csv"
    raw.write.csv(path, header=True)
    return rounded(load_csv(spark, path, ids=("absent",), max_features=None, max_samples=None, row_id="id").df)


@query
def question_mark_codes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    raw = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "?").otherwise(F.col("p_size").cast("string")).alias("size"), F.col("p_brand").alias("brand"))
    return frame_of(raw, row_id="id", question_mark="codes").wide()


@query
def question_mark_to_null(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "?").otherwise(F.col("c_mktsegment")).alias("segment"))
    return prepare.marks_to_null(c, ["segment"])


@query
def codes_by_first_appearance(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("segment"))
    return prepare.codes_by_first_appearance(c, "segment", "c_custkey", "code").select("c_custkey", "code")


@query
def label_codes(spark, d):
    return prepare.label_codes(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query
def catalogue_load(spark, d):
    return rounded(CATALOGUE.load(spark, "users", d).wide())


@query
def catalogue_offline(spark, d):
    """Every entry that needs no network, loaded: its classes as stated and as found, and its rows."""
    found = None
    for name in CATALOGUE.available_offline():
        one = CATALOGUE.load(spark, name, d).wide().agg(F.lit(name).alias("name"), F.countDistinct("y").alias("n_found"), F.count(F.lit(1)).alias("n_rows"))
        found = one if found is None else found.unionByName(one)
    return CATALOGUE.table(spark).where("offline").select("name", "n_classes").join(found, "name")


@query
def ordered_fallbacks(spark, d):
    def missing():
        return frame_of(spark.read.parquet(f"{d}/no_such_table.parquet"))

    return rounded(first_that_loads([missing, lambda: documents_frame(spark, d)], "documents").wide())


@query
def cached_frame(spark, d):
    frame = documents_frame(spark, d, "toxic")
    return rounded(frame.with_df(frame.df.cache()).wide())


def customers(spark: SparkSession, d: str) -> DataFrame:
    """The keys that generated tables have rows for."""
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")


@query
def synthetic_source(spark, d):
    return rounded(synthetic.make_synthetic(spark, ids=customers(spark, d)).wide())


@query
def madelon_like_source(spark, d):
    return rounded(synthetic.make_madelon_like(spark, ids=customers(spark, d)).wide())


@query
def structural_source(spark, d):
    return rounded(synthetic.make_structural(spark, ids=customers(spark, d)).wide())


def results_table(spark: SparkSession, d: str) -> DataFrame:
    """A result table of five data sets, eight methods and three seeds, made from orders."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    method = F.get(F.array(*map(F.lit, report.METHODS)), (F.col("o_custkey") % 8).cast("int"))
    g = o.groupBy(F.col("o_orderpriority").alias("dataset"), method.alias("method"), (F.col("o_orderkey") % 3).cast("int").alias("seed"))
    price = F.col("o_totalprice")
    return g.agg(
        F.lit(10).alias("k"), F.round(F.avg(price) / 500000, 3).alias("accuracy"), F.round(F.count(F.lit(1)) / 100, 1).alias("stability"), F.round(F.max(price) / 600000, 2).alias("trustworthiness"), F.round(F.min(price) / 1000, 2).alias("runtime_s"),
        F.when(~F.first("o_orderpriority").startswith("1"), F.round(F.avg(price) / 400000, 2)).alias("causal_plausibility"), F.when(~F.first("o_orderpriority").startswith("1"), F.round(F.max(price) / 700000, 2)).alias("causal_recall"),
    )


METRICS = ["accuracy", "stability", "trustworthiness", "runtime_s"]


@query
def results_round_trip(spark, d):
    path = f"{shared_dir(spark)}/sieveline/{uuid.uuid4().hex}-results"
    table = results_table(spark, d)
    R.write_results(table.where("seed = 0"), path)
    R.write_results(table.where("seed > 0"), path, append=True)
    return R.read_results(spark, path)


@query
def latex_table(spark, d):
    t = results_table(spark, d)
    order = report.in_order(report.means(t, METRICS)).where("accuracy is not null").select("method", *METRICS).collect()
    text = R.latex_table([r.asDict() for r in order], [r.asDict() for r in report.deviations(t, METRICS).collect()])
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query
def config_manifest(spark, d):
    frame = orders_frame(spark, d)
    return spark.createDataFrame([(R.manifest(Config(), dataset=frame.name, features=frame.features, rows=frame.df.count()),)], "manifest string")


@query
def markdown_report(spark, d):
    rows = report.in_order(report.means(results_table(spark, d), METRICS)).select("method", *METRICS).collect()
    return spark.createDataFrame(list(enumerate(R.markdown_table([r.asDict() for r in rows]).split("\n"))), "line int, text string")


@query
def significance_report(spark, d):
    return spark.createDataFrame(list(enumerate(X.significance(results_table(spark, d)).split("\n"))), "line int, text string")


# --- preparation ---------------------------------------------------------------------------------------------


@query
def median_impute(spark, d):
    return rounded(prepare.impute(holes(documents_frame(spark, d))).df)


@query
def variance_cap(spark, d):
    return rounded(prepare.variance_cap(embeddings_frame(spark, d), 12).long().select("row_id", F.col("f").cast("int").alias("f"), "x"))


@query
def stratified_sample(spark, d):
    return prepare.stratified_sample(orders_frame(spark, d), 600).wide().select("row_id", "y")


@query
def common_schema(spark, d):
    return rounded(prepare.common_schema(holes(orders_frame(spark, d)).stored(), 4, 500).wide())


@query
def standardise(spark, d):
    return rounded(prepare.Standardiser().fit_transform(holes(orders_frame(spark, d)).stored()).df)


@query
def standardise_apply(spark, d):
    frame = orders_frame(spark, d).stored()
    half = frame.with_df(frame.df.where("row_id % 2 = 0"))
    return rounded(prepare.Standardiser().fit(half).transform(frame).df)


@query
def centre_only(spark, d):
    return rounded(prepare.Standardiser(with_std=False).fit_transform(documents_frame(spark, d)).df)


@query
def transpose(spark, d):
    return prepare.transpose(documents_frame(spark, d))


@query
def anova_f(spark, d):
    return rounded(prepare.anova_f(orders_frame(spark, d)), 4)


@query
def anova_prefilter(spark, d):
    return listed(spark, prepare.prefilter(embeddings_frame(spark, d), 16)[1])


@query
def anova_prefilter_fold(spark, d):
    frame = embeddings_frame(spark, d)
    train = frame.with_df(frame.df.where("row_id % 5 != 0"))
    return rounded(prepare.top_features(prepare.anova_f(train), 20), 4)


@query
def restrict_candidates(spark, d):
    return prepare.restrict_candidates(listed(spark, [3, 5]), prepare.anova_f(orders_frame(spark, d)), 4)


@query
def project_selected(spark, d):
    z = prepare.Standardiser().fit_transform(orders_frame(spark, d).stored())
    return rounded(z.take([1, 3]).wide())


@query
def support_mask(spark, d):
    return prepare.support_mask(6, prepare.top_features(prepare.anova_f(orders_frame(spark, d)), 3).select("f"))


# --- causal discovery and relevance ---------------------------------------------------------------------------


@query
def partial_correlation(spark, d):
    return rounded(causal.partial_correlations(orders_frame(spark, d), 1))


@query
def label_correlation(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return rounded(spark.createDataFrame([(i, K.partial_correlation(g, i)) for i in range(g.p)], "f int, score double"))


@query
def partial_correlation_gram(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return rounded(spark.createDataFrame([(i, K.partial_correlation(g, i, [1])) for i in range(g.p) if i != 1], "f int, score double"))


@query
def fisher_z_test(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return rounded(spark.createDataFrame([(i, K.fisher_z(K.partial_correlation(g, i, [0]), g.n, 1)) for i in range(1, g.p)], "f int, p double"))


@query
def markov_blanket(spark, d):
    return listed(spark, K.markov_blanket(stats.gram(orders_frame(spark, d))))


@query
def mutual_information(spark, d):
    return rounded(causal.mutual_information(documents_frame(spark, d)))


@query
def mutual_information_scaled(spark, d):
    return rounded(causal.over_max(causal.mutual_information(users_frame(spark, d))))


@query
def rank_normalise(spark, d):
    return rounded(causal.rank_normalise(prepare.anova_f(orders_frame(spark, d))))


@query
def blanket_confidence(spark, d):
    return rounded(causal.vector_frame(orders_frame(spark, d), causal.blanket_confidence(orders_frame(spark, d))))


def _scores(spark, d):
    """(blanket as 0 or 1 for features 1 to 3, predictive scores) of the orders."""
    frame = orders_frame(spark, d)
    return causal.vector_frame(frame, np.array([0, 1, 1, 1, 0, 0])), causal.over_max(prepare.anova_f(frame))


@query
def causal_relevance(spark, d):
    return rounded(causal.blend(*_scores(spark, d), 0.3))


@query
def causal_relevance_ranked(spark, d):
    return rounded(causal.blend(*_scores(spark, d), 0.15, True))


@query
def conditional_relevance(spark, d):
    frame = orders_frame(spark, d)
    return rounded(causal.vector_frame(frame, K.conditional_relevance(stats.gram(frame))))


@query
def forest_relevance(spark, d):
    frame = documents_frame(spark, d)
    return rounded(causal.vector_frame(frame, causal.forest_relevance(frame)))


@query
def causal_analysis(spark, d):
    frame = documents_frame(spark, d)
    m = Selector(Config(n_bootstrap=0)).fit(frame)
    rows = [(i, float(m.mb_mask_[i]), float(m.predictive_[i]), float(m.relevance_[i])) for i in range(frame.p)]
    return rounded(spark.createDataFrame(rows, "f int, mb double, predictive double, relevance double"))


# --- structure -----------------------------------------------------------------------------------------------


@query
def correlation_pairs(spark, d):
    return rounded(stats.correlation_pairs(orders_frame(spark, d)))


@query
def correlation_pairs_wide(spark, d):
    frame = embeddings_frame(spark, d)
    return rounded(stats.pairs_of(frame, stats.gram(frame).correlations()))


@query
def feature_graph(spark, d):
    return rounded(structure.edges(stats.correlation_pairs(orders_frame(spark, d))))


@query
def weighted_degree(spark, d):
    return rounded(structure.weighted_degree(structure.edges(stats.correlation_pairs(orders_frame(spark, d))), 6))


@query
def hybrid_distance(spark, d):
    frame = orders_frame(spark, d)
    return rounded(structure.hybrid_pairs(stats.correlation_pairs(frame), causal.over_max(prepare.anova_f(frame))))


def _distance(spark, d) -> np.ndarray:
    frame = orders_frame(spark, d)
    rel = np.zeros(frame.p)
    for r in causal.over_max(prepare.anova_f(frame)).collect():
        rel[r["f"]] = r["score"]
    return K.hybrid_distance(stats.gram(frame).correlations(), rel, 0.5)


@query
def linkage_labels(spark, d):
    dist = _distance(spark, d)
    labels = K.cut(K.average_linkage(dist), 6, 3)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "f int, cluster int")


@query
def linkage_merges(spark, d):
    return rounded(structure.merge_table(spark, K.average_linkage(_distance(spark, d))))


def _clusters(spark) -> DataFrame:
    return spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)], "f int, cluster int")


@query
def composite_score(spark, d):
    blanket, predictive = _scores(spark, d)
    central = structure.weighted_degree(structure.edges(stats.correlation_pairs(orders_frame(spark, d))), 6)
    return rounded(structure.composite(central, causal.blend(blanket, predictive, 0.5), predictive))


@query
def cluster_representatives(spark, d):
    return structure.representatives(_clusters(spark), prepare.anova_f(orders_frame(spark, d)))


def _order(spark, order: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, int(f)) for i, f in enumerate(order)], "step int, f int")


@query
def greedy_selection(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return _order(spark, K.greedy(np.array([abs(K.partial_correlation(g, i)) for i in range(g.p)]), g.correlations(), 4))


@query
def greedy_grouped_selection(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return _order(spark, K.greedy(np.array([abs(K.partial_correlation(g, i)) for i in range(g.p)]), g.correlations(), 4, 1.0, 0.7, 0.3, [0, 1, 1, 1, 2, 2]))


def _selector_rows(spark, model: Selector) -> DataFrame:
    return rounded(spark.createDataFrame([(int(f), float(model.relevance_[f]), float(model.stability_)) for f in model.selected_features_], "f int, relevance double, stability double"))


@query
def prototype_modes(spark, d):
    frame, out, shared = orders_frame(spark, d), [], {}
    for mode in ("composite", "relevance", "predictive", "greedy"):
        m = Selector(Config(n_representatives=3, n_bootstrap=0, prototype_by=mode, conditional_relevance=True)).fit(frame, shared=shared)
        out += [(mode, int(f)) for f in m.selected_features_]
    return spark.createDataFrame(out, "mode string, f int")


@query
def select_once(spark, d):
    return _selector_rows(spark, Selector(Config(n_representatives=3, enable_stability=False)).fit(documents_frame(spark, d)))


# --- merge review ------------------------------------------------------------------------------------------


def _merges(spark) -> DataFrame:
    return spark.createDataFrame([(0, [2], [3], 0.1), (1, [1], [2, 3], 0.13), (2, [0], [4], 0.5), (3, [0, 4], [1, 2, 3], 0.7), (4, [0, 1, 2, 3, 4], [5], 0.72)], "step int, `left` array<int>, `right` array<int>, distance double")


def _reviews(spark, d) -> DataFrame:
    blanket, predictive = _scores(spark, d)
    scores = predictive.select("f", F.col("score").alias("relevance")).join(blanket.select("f", F.col("score").alias("mb")), "f")
    return structure.ambiguous_merges(_merges(spark), scores)


@query
def ambiguous_merges(spark, d):
    return rounded(_reviews(spark, d).drop("left", "right"))


@query
def merge_decisions(spark, d):
    return structure.rule_decisions(_reviews(spark, d)).select("step", "decision")


@query
def merge_veto_rate(spark, d):
    return rounded(structure.veto_rate(structure.rule_decisions(_reviews(spark, d))))


@query
def merge_vetoed_pairs(spark, d):
    return structure.vetoed_pairs(structure.rule_decisions(_reviews(spark, d)))


@query
def distances_with_vetoes(spark, d):
    pairs = structure.hybrid_pairs(stats.correlation_pairs(orders_frame(spark, d)), causal.over_max(prepare.anova_f(orders_frame(spark, d))))
    vetoed = structure.vetoed_pairs(structure.rule_decisions(_reviews(spark, d)))
    return rounded(structure.with_vetoes(pairs.select("f_i", "f_j", F.col("d_hybrid").alias("d")), vetoed))


@query
def reviewed_selection(spark, d):
    m = Selector(Config(n_representatives=3, n_bootstrap=0, enable_hitl=True, conditional_relevance=True)).fit(orders_frame(spark, d))
    return rounded(spark.createDataFrame([(int(f), float(m.veto_rate_)) for f in m.selected_features_], "f int, veto_rate double"))


# --- consensus -----------------------------------------------------------------------------------------------


@query
def bootstrap_resample(spark, d):
    return consensus.md5_resample(documents_frame(spark, d), 4)


@query
def bootstrap_gram(spark, d):
    frame = orders_frame(spark, d)
    found = stats.grams(frame, weights=consensus.md5_resample(frame, 3))
    rows = [(b, i, float(g.n), float(g.mean[i]), K.partial_correlation(g, i)) for b, g in found.items() for i in range(g.p)]
    return rounded(spark.createDataFrame(rows, "b int, f int, n double, mean double, r double"), 4)


@query
def bootstrap_runs(spark, d):
    frame = documents_frame(spark, d)
    runs = consensus.bootstrap_runs(frame, consensus.md5_resample(frame, 2).cache(), 2, lambda x: [r["f"] for r in prepare.top_features(prepare.anova_f(x), 2).collect()])
    return consensus.selections_table(spark, runs)


def selections(spark: SparkSession, d: str) -> DataFrame:
    """Five selections b of up to four of the numbers 0 to 8, made up from the lines with l_orderkey % 5 = b."""
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 5).cast("int").alias("b")).agg(F.array_sort(F.collect_set((F.floor(F.col("l_extendedprice")) % 7 + F.col("l_orderkey") % 3).cast("int"))).alias("all")).select("b", F.slice("all", F.col("b") % 3 + 1, 4).alias("selected"))


@query
def jaccard_pairs(spark, d):
    return rounded(consensus.jaccard_pairs(selections(spark, d)))


@query
def stability_index(spark, d):
    return rounded(consensus.stability(selections(spark, d)))


@query
def consensus_votes(spark, d):
    return rounded(consensus.votes(selections(spark, d)))


@query
def consensus_selection(spark, d):
    return consensus.consensus(selections(spark, d), 0.5, 3)


@query
def consensus_threshold(spark, d):
    return consensus.consensus(selections(spark, d), 0.5)


@query
def cluster_consensus(spark, d):
    canonical = spark.createDataFrame([(0, 0), (1, 2), (2, 5)], "cluster int, f int")
    return consensus.cluster_consensus(selections(spark, d), _clusters(spark), canonical, 0.5, 3)


@query
def co_association(spark, d):
    labels = selections(spark, d).select("b", F.posexplode("selected").alias("i", "f")).select("b", "f", (F.col("i") % 2).alias("cluster"))
    return rounded(consensus.co_association(labels, 5))


@query
def kuncheva_index(spark, d):
    return rounded(consensus.kuncheva_pairs(selections(spark, d), 9))


@query
def causal_plausibility(spark, d):
    """Of the numbers that half of the selections have, against 0 to 4."""
    return rounded(consensus.plausibility(consensus.consensus(selections(spark, d), 0.5), listed(spark, [0, 1, 2, 3, 4])))


@query
def consensus_clustering(spark, d):
    return _selector_rows(spark, Selector(Config(n_representatives=3, consensus_clustering=True, n_bootstrap=8, conditional_relevance=True)).fit(orders_frame(spark, d)))


@query
def fit_consensus(spark, d):
    return _selector_rows(spark, Selector(Config(n_representatives=3, n_bootstrap=10, conditional_relevance=True)).fit(orders_frame(spark, d)))


@query
def fit_soft(spark, d):
    return _selector_rows(spark, Selector(soft(2, 4)).fit(documents_frame(spark, d)))


@query
def fit_strict(spark, d):
    frame = synthetic.make_structural(spark, ids=customers(spark, d))
    return _selector_rows(spark, Selector(strict(6, frame.p)).fit(frame))


@query
def fit_cluster_vote(spark, d):
    return _selector_rows(spark, Selector(Config(n_representatives=3, cluster_consensus=True, n_bootstrap=8, conditional_relevance=True)).fit(orders_frame(spark, d)))


@query
def fit_transform(spark, d):
    return rounded(Selector(Config(n_representatives=2, n_bootstrap=4, conditional_relevance=True)).fit_transform(orders_frame(spark, d)).wide())


@query
def wrapper_refine(spark, d):
    m = Selector(Config(n_representatives=2, n_bootstrap=0, wrapper_refine=True, conditional_relevance=True)).fit(documents_frame(spark, d))
    return listed(spark, m.selected_features_)


# --- baselines ------------------------------------------------------------------------------------------------


def _baseline(name: str, frame_of_: Callable = orders_frame, k: int = 3) -> None:
    def run(spark, d):
        return listed(spark, baselines.build_baseline(name, k).fit(frame_of_(spark, d)).selected_features_)

    run.__name__ = f"baseline_{name.lower()}"
    query(run)


for _name in baselines.BASELINES:
    _baseline(_name, documents_frame if _name in ("mRMR", "CausalDRIFT", "CAFE") else orders_frame, 2 if _name in ("mRMR", "CausalDRIFT", "CAFE") else 3)


@query
def pca_projection(spark, d):
    z = baselines.build_baseline("PCA", 2).fit_transform(orders_frame(spark, d))
    return rounded(z.df.select("row_id", *[F.abs(c).alias(c) for c in z.features]), 4)


@query
def mrmr_kernel(spark, d):
    g = stats.gram(orders_frame(spark, d))
    return _order(spark, K.greedy(np.array([abs(K.partial_correlation(g, i)) for i in range(g.p)]), g.correlations(), 4, 1.0, 0.0))


# --- evaluation --------------------------------------------------------------------------------------------------


@query
def folds(spark, d):
    return evaluate.with_folds(documents_frame(spark, d))[0].select("row_id", "y", "fold")


@query
def knn_predictions(spark, d):
    return evaluate.fold_predictions(embeddings_frame(spark, d))


@query
def knn_accuracy(spark, d):
    return rounded(evaluate.accuracy(evaluate.fold_predictions(documents_frame(spark, d))))


@query
def balanced_accuracy(spark, d):
    return rounded(evaluate.balanced_accuracy(evaluate.fold_predictions(documents_frame(spark, d))))


@query
def trustworthiness(spark, d):
    return rounded(evaluate.trustworthiness(embeddings_frame(spark, d), [0, 2, 5]))


@query
def smallest_k_within(spark, d):
    curve = results_table(spark, d).groupBy((F.col("seed") * 4 + F.length("method")).alias("k")).agg(F.avg("accuracy").alias("accuracy"))
    return evaluate.smallest_within(curve, 0.02)


def _folds_table(spark, d) -> tuple[DataFrame, DataFrame]:
    t = results_table(spark, d)
    k = (F.length("method") - 2).alias("k")
    return t.select(k, F.col("accuracy").alias("perf"), (1 - F.col("trustworthiness")).alias("redundancy")), t.groupBy(k).agg((F.avg("accuracy") + 0.3).alias("stability"))


@query
def fold_summary(spark, d):
    return rounded(evaluate.summarise_folds(*_folds_table(spark, d)))


@query
def choose_k(spark, d):
    return rounded(evaluate.choose_k(evaluate.summarise_folds(*_folds_table(spark, d)), 0.6))


@query
def min_max(spark, d):
    return rounded(evaluate.min_max(report.means(results_table(spark, d), METRICS), METRICS))


@query
def suggest_k(spark, d):
    return rounded(X.suggest_k(documents_frame(spark, d))[1])


@query
def select_k_nested(spark, d):
    return rounded(X.select_k_nested(documents_frame(spark, d), folds=5, repeats=3)[1])


@query
def evaluate_method(spark, d):
    row = X.evaluate_method("Proposed", lambda s: Selector(Config(n_representatives=2, n_bootstrap=2, random_state=s, conditional_relevance=True), artefacts=False), documents_frame(spark, d), 2, 2)
    return spark.createDataFrame([row], R.RESULT_SCHEMA)


@query
def friedman_statistic(spark, d):
    return rounded(report.friedman(results_table(spark, d), "accuracy"))


@query
def wilcoxon_ranks(spark, d):
    return rounded(report.signed_ranks(results_table(spark, d), "accuracy"))


@query
def wilcoxon_test(spark, d):
    rows = report.pivot(results_table(spark, d), "accuracy", names=report.METHODS).collect()
    return rounded(spark.createDataFrame([(m, K.wilcoxon([r["Proposed"] for r in rows], [r[m] for r in rows])) for m in report.METHODS[1:]], "method string, p double"))


# --- reports ---------------------------------------------------------------------------------------------------


@query
def mean_by_method(spark, d):
    return rounded(report.means(results_table(spark, d), METRICS))


@query
def mean_by_dataset_method(spark, d):
    return rounded(report.means(results_table(spark, d), METRICS, ("dataset", "method")))


@query
def mean_std_text(spark, d):
    return report.mean_std_text(results_table(spark, d), METRICS)


@query
def average_ranks(spark, d):
    return rounded(report.average_ranks(results_table(spark, d), METRICS))


@query
def pivot_accuracy(spark, d):
    return rounded(report.pivot(results_table(spark, d), "accuracy", names=report.METHODS))


@query
def pivot_plausibility(spark, d):
    return rounded(report.with_row_mean(report.pivot(results_table(spark, d), "causal_plausibility", "method", "dataset", PRIORITIES), [f"`{p}`" for p in PRIORITIES]))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query
def pareto_frontier(spark, d):
    return rounded(report.pareto(report.means(results_table(spark, d), METRICS), "accuracy", "runtime_s"))


@query
def best_per_column(spark, d):
    return report.best_marks(report.means(results_table(spark, d), METRICS), METRICS)


@query
def best_per_row(spark, d):
    return report.best_in_row(report.pivot(results_table(spark, d), "accuracy", names=report.METHODS), report.METHODS)


@query
def best_method(spark, d):
    return rounded(report.best_method(report.means(results_table(spark, d), METRICS), METRICS))


@query
def first_k(spark, d):
    return report.first_k(results_table(spark, d))


@query
def report_shape(spark, d):
    return report.shape(results_table(spark, d))


@query
def method_order(spark, d):
    return rounded(report.in_order(report.means(results_table(spark, d).where("method != 'VAE'"), METRICS)))


@query
def mean_row(spark, d):
    return report.with_mean_row(report.pivot(results_table(spark, d), "stability", names=report.METHODS), "dataset", report.METHODS)


@query
def most_stable(spark, d):
    return rounded(report.most_stable(results_table(spark, d), ("PCA", "LASSO", "mRMR", "Random")))


# --- drivers ---------------------------------------------------------------------------------------------------


@query
def run_methods(spark, d):
    return X.run_methods(documents_frame(spark, d), 2, ("PCA", "Random"), resamples=2)


@query
def ablation(spark, d):
    out = X.ablation([documents_frame(spark, d)], 3, 8)
    return out.toDF(*[c.replace(" ", "_").replace("/", "") for c in out.columns])


@query
def alpha_sensitivity(spark, d):
    return rounded(X.sensitivity([documents_frame(spark, d)], 2))


@query
def plausibility_experiment(spark, d):
    """Both ways of selection and two baselines on a structural table with a row for each customer."""
    return rounded(X.plausibility(spark, 6, 2, (0,), ("PCA", "mRMR"), ids=customers(spark, d)))


@query
def simulation_frequencies(spark, d):
    frame = orders_frame(spark, d)
    return rounded(causal.vector_frame(frame, X.simulate(frame, Config(n_representatives=3, n_bootstrap=8, conditional_relevance=True))["frequency"]))


@query
def stage_preview(spark, d):
    return X.preview(orders_frame(spark, d))


@query
def stage_descriptions(spark, d):
    """What each stage does, beside the size of the table that it gets."""
    sizes = orders_frame(spark, d).wide().agg(F.count(F.lit(1)).alias("n_rows"), F.lit(6).alias("n_features"))
    return spark.createDataFrame(list(STAGES), "stage string, detail string").crossJoin(sizes)


@query
def selection_trace(spark, d):
    m = Selector(Config(n_representatives=3, n_bootstrap=3, conditional_relevance=True)).fit(orders_frame(spark, d))
    return spark.createDataFrame([(t["stage"], t["detail"]) for t in m.trace], "stage string, detail string")


@query
def screening_flagship(spark, d):
    """Impute, standardise, correlate, weigh the graph, score by F and take the three best features: one row each."""
    z = prepare.Standardiser().fit_transform(holes(orders_frame(spark, d)).stored()).stored()
    central = structure.weighted_degree(structure.edges(stats.correlation_pairs(z)), z.p)
    best = prepare.top_features(prepare.anova_f(z), 3)
    return rounded(best.join(central.select("f", F.col("score").alias("centrality")), "f"), 4)
