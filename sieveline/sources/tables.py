"""CSV files, a catalogue of named feature tables, and feature tables over the star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sieveline.frame import FeatureFrame
from sieveline.operators.prepare import codes_by_first_appearance, common_schema, label_codes, marks_to_null

_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType, T.BooleanType)


def frame_of(df: DataFrame, label: str | None = None, ids: tuple[str, ...] = (), row_id: str | None = None, name: str = "", question_mark: str = "null") -> FeatureFrame:
    """A feature table from any DataFrame: drop ids, encode text columns and the label (the last column by default).

    question_mark says what "?" in a text column means: "null" makes it missing and the column numeric if the rest is;
    "codes" keeps such a column text, with "?" missing (-1). Text columns get codes by first appearance.
    """
    if row_id is None:
        df, row_id = df.withColumn("row_id", F.monotonically_increasing_id()), "row_id"
    df = df.drop(*[c for c in ids if c in df.columns and c != row_id])
    label = label or [c for c in df.columns if c != row_id][-1]
    features = [c for c in df.columns if c not in (label, row_id)]
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    df = marks_to_null(df, text)
    if question_mark == "null" and text:
        bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in text]).first()
        numbers = [c for c in text if bad[c] == 0]
        df = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers})
        text = [c for c in text if c not in numbers]
    for c in text:
        df = codes_by_first_appearance(df, c, row_id, "sieveline_code").drop(c).withColumnRenamed("sieveline_code", c)
    df = label_codes(df.where(F.col(label).isNotNull()), label, "sieveline_label").drop(label).withColumnRenamed("sieveline_label", "y")
    return FeatureFrame(df, tuple(features), "y", row_id, name)


def load_csv(spark: SparkSession, path: str, label: str | None = None, ids: tuple[str, ...] = (), max_features: int | None = 120, max_samples: int | None = 600, name: str = "custom", row_id: str | None = None, question_mark: str = "null") -> FeatureFrame:
    """Read a CSV with a header; listed ids that it lacks are ignored. Caps of None keep all columns or rows."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return common_schema(frame_of(df, label, ids, row_id, name, question_mark), max_features, max_samples)


def first_that_loads(attempts: list[Callable[[], FeatureFrame]], name: str) -> FeatureFrame:
    """The result of the first attempt that doesn't raise."""
    errors = []
    for attempt in attempts:
        try:
            return attempt()
        except Exception as e:  # noqa: BLE001
            errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
    raise RuntimeError(f"{name} could not be loaded: {'; '.join(errors)}")


# --- feature tables over the star schema -------------------------------------------------------------


def orders_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Orders with their lines' totals; the label says whether any line was returned."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    sums = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    df = o.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("total"), "n_lines", "quantity", "price", "discount", "tax", "y")
    return FeatureFrame(df, ("total", "n_lines", "quantity", "price", "discount", "tax"), name="orders")


def prices_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Orders' lines; the label is the order's price."""
    return replace(orders_frame(spark, sf_dir).take([1, 2, 3, 4, 5]), label="total", discrete=False, name="prices")


def balances_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Customers' orders and nation; the label is their balance."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    sums = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.max("o_totalprice").alias("dearest"))
    df = c.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    df = df.select(F.col("c_custkey").alias("row_id"), F.coalesce("orders", F.lit(0.0)).alias("orders"), "dearest", F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").alias("y"))
    return FeatureFrame(df, ("orders", "dearest", "nation"), name="balances", discrete=False)


def embeddings_frame(spark: SparkSession, sf_dir: str, width: int = 64) -> FeatureFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = tuple(f"e{i}" for i in range(width))
    df = e.select(F.col("vec_id").alias("row_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)], F.col("label").alias("y"))
    return FeatureFrame(df, names, name="embeddings")


def documents_frame(spark: SparkSession, sf_dir: str, label: str = "quality") -> FeatureFrame:
    """Counts of characters, spaces, line ends and digits of labelled documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    y = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("y"))
    kinds = {"spaces": " ", "newlines": "\n"}
    counts = [(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double").alias(k) for k, c in kinds.items()]
    digits = (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).cast("double").alias("digits")
    df = d.join(y, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("chars"), *counts, digits, "y")
    return FeatureFrame(df, ("chars", "spaces", "newlines", "digits"), name=f"documents-{label}")


def users_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Users' events by kind, and statistics of their values; the label says whether they purchase more than the median user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", "props")
    kinds = ("click", "view", "error", "signup")
    agg = e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds], F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.stddev_samp("value").alias("std_value"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("avg_k"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    middle = agg.agg(F.median("bought").alias("middle"))
    df = agg.crossJoin(middle).withColumn("y", (F.col("bought") > F.col("middle")).cast("int")).withColumnRenamed("user_id", "row_id").drop("bought", "middle")
    return FeatureFrame(df, (*kinds, "avg_value", "max_value", "std_value", "avg_k"), name="users")


# --- catalogue -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    """A named feature table; offline ones need no network."""

    name: str
    load: Callable[[SparkSession, str], FeatureFrame]
    n_classes: int
    notes: str = ""
    offline: bool = True


class Catalogue:
    def __init__(self, entries: list[Entry]) -> None:
        self.entries = {e.name: e for e in entries}

    def load(self, spark: SparkSession, name: str, root: str, max_features: int | None = None, max_samples: int | None = None) -> FeatureFrame:
        """KeyError for unknown names, RuntimeError if a known table doesn't load."""
        entry = self.entries[name]
        try:
            frame = entry.load(spark, root)
        except Exception as e:
            raise RuntimeError(f"{name} could not be loaded: {e}") from e
        return common_schema(frame, max_features, max_samples) if max_features or max_samples else frame

    def available_offline(self) -> list[str]:
        return [e.name for e in self.entries.values() if e.offline]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.name, e.n_classes, e.notes, e.offline) for e in self.entries.values()], "name string, n_classes int, notes string, offline boolean")


def _remote(name: str) -> Callable[[SparkSession, str], FeatureFrame]:
    def load(spark: SparkSession, root: str) -> FeatureFrame:
        paths = [f"{root}/{name}.{kind}" for kind in ("parquet", "csv")]
        return first_that_loads([lambda: frame_of(spark.read.parquet(paths[0]), name=name), lambda: load_csv(spark, paths[1], max_features=None, max_samples=None, name=name)], name)

    return load


CATALOGUE = Catalogue(
    [
        Entry("orders", orders_frame, 2, "orders with their lines' totals"),
        Entry("embeddings", embeddings_frame, 10, "64 embedding dimensions"),
        Entry("documents-quality", lambda s, d: documents_frame(s, d, "quality"), 2, "character counts"),
        Entry("documents-toxic", lambda s, d: documents_frame(s, d, "toxic"), 2, "character counts"),
        Entry("users", users_frame, 2, "event statistics"),
        *[Entry(n, _remote(n), k, "a file below the root", False) for n, k in (("wine", 3), ("iris", 3), ("breast_cancer", 2), ("digits", 10), ("glass", 6), ("ionosphere", 2), ("sonar", 2), ("spambase", 2), ("isolet", 26), ("madelon", 2), ("zoo", 7), ("musk", 2), ("arrhythmia", 13), ("crowdsourced", 6), ("mnist_784", 10), ("olivetti", 40))],
    ]
)
