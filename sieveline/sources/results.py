"""Result tables: their schema, reader and sinks."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RESULT_SCHEMA = "dataset string, method string, seed int, k int, accuracy double, stability double, trustworthiness double, runtime_s double, causal_plausibility double, causal_recall double"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV, with NaN as NULL."""
    df = spark.read.csv(path, header=True, schema=RESULT_SCHEMA)
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers})


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    """One CSV with a header; append adds the rows of one more dataset."""
    df.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True)


def manifest(config: object, **more: object) -> str:
    """A run's configuration as JSON."""
    return json.dumps({**asdict(config), **more}, indent=2, sort_keys=True, default=str)


def markdown_table(rows: list[dict]) -> str:
    heads = list(rows[0]) if rows else []
    line = lambda cells: "| " + " | ".join(cells) + " |"
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([line(heads), line(["---"] * len(heads)), *(line([show(r[h]) for h in heads]) for r in rows)])


def latex_table(means: list[dict], deviations: list[dict], lower_better: tuple[str, ...] = ("runtime_s",), caption: str = "Mean metrics across datasets.") -> str:
    """A booktabs table of rows {method, metric: mean}: the best mean of each column is bold, deviations above 0 are added."""
    metrics = [c for c in means[0] if c != "method"]
    best = {m: (min if m in lower_better else max)(r[m] for r in means if r[m] is not None) for m in metrics}
    spread = {r["method"]: r for r in deviations}
    body = []
    for r in means:
        cells = []
        for m in metrics:
            value, sd = r[m], (spread.get(r["method"], {}).get(m) or 0.0)
            cell = "--" if value is None else f"{value:.3f}" + (rf" $\pm$ {sd:.3f}" if sd > 0 else "")
            cells.append(rf"\textbf{{{cell}}}" if value == best[m] else cell)
        body.append(" & ".join([r["method"].replace("_", r"\_"), *cells]) + r" \\")
    head = " & ".join(["Method", *(m.replace("_", " ") for m in metrics)]) + r" \\"
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'c' * len(metrics)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def significance_text(statistic: float, p: float, rows: list[dict]) -> str:
    out = [f"Friedman chi-squared = {statistic:.3f}, p = {p:.4g}", ""]
    return "\n".join(out + [f"{r['method']}: mean difference {r['delta']:+.4f}, Wilcoxon p = {r['p']:.4g}" for r in rows])
