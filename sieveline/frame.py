"""A labelled numeric table: the data model of the feature-selection operators."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from sieveline.session import shared_dir


@dataclass(frozen=True)
class FeatureFrame:
    """A wide DataFrame with a row id, double feature columns (missing is NULL) and a label: codes from 0, or any numbers if it
    isn't `discrete`.

    Feature f of the operators' results is a position in `features`. Only the columns named here are ever read.
    """

    df: DataFrame
    features: tuple[str, ...]
    label: str = "y"
    row_id: str = "row_id"
    name: str = ""
    truth: tuple[int, ...] | None = None
    redundant: tuple[int, ...] | None = None
    discrete: bool = True

    @property
    def p(self) -> int:
        return len(self.features)

    def wide(self) -> DataFrame:
        """(row_id, y, features): doubles, with NaN as NULL."""
        x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in self.features]
        return self.df.select(F.col(f"`{self.row_id}`").alias("row_id"), F.col(f"`{self.label}`").cast("int" if self.discrete else "double").alias("y"), *x)

    def long(self) -> DataFrame:
        """(row_id, y, f, x), a row for each cell; no shuffle."""
        cells = F.array(*[F.col(f"`{c}`") for c in self.features])
        return self.wide().select("row_id", "y", F.posexplode(cells).alias("f", "x"))

    def take(self, keep: list[int]) -> FeatureFrame:
        return replace(self, features=tuple(self.features[i] for i in keep), truth=None, redundant=None)

    def with_df(self, df: DataFrame) -> FeatureFrame:
        return replace(self, df=df)

    def stored(self) -> FeatureFrame:
        """The same table written to the shared folder, so that later passes read it rather than make it again."""
        path = f"{shared_dir(self.df.sparkSession)}/sieveline/{uuid.uuid4().hex}-frame"
        wide = self.wide()
        wide.write.parquet(path)
        return replace(self, df=wide.sparkSession.read.schema(wide.schema).parquet(path), row_id="row_id", label="y")

    def n_classes(self) -> int:
        return self.df.select(self.label).distinct().count()
