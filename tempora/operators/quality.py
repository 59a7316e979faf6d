"""Categorical encoding and out-of-range input checks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def one_hot_drop_first(df: DataFrame, column: str, categories: Sequence) -> DataFrame:
    """P5: int 0/1 indicator column per named category except the first in
    sorted order; NULL and unnamed values map to all zeros.  A column is
    called ``<column>_<value>``, with the value as it is, so different
    values never share a name.  For an open set of categories use
    :func:`one_hot_long`."""
    enc = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
           for v in sorted(set(categories))[1:]]
    return df.select(*[c for c in df.columns if c != column], *enc)


def one_hot_long(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """P5 for any number of categories: the ones of the encoding as rows
    ``(keys…, category)``.  The first category in sorted order and NULL have
    no row; the only thing read from the data is that first category."""
    first = df.agg(F.min(column)).first()[0]
    rows = df.select(*keys, F.col(column).alias("category"))
    return rows.filter(F.col("category") != F.lit(first)) if first is not None else rows.limit(0)


def validate_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Missing expected columns raise; extra columns are dropped; the
    result is in the model's feature order (P2), after any ``keep``
    columns (keys, stamp)."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[c for c in keep if c in df.columns], *expected)


def display_round(df: DataFrame, decimals: int = 4, columns: Sequence[str] | None = None) -> DataFrame:
    """P10: half-even rounding (as numpy) of double columns, for exports
    and display only; queries never round intermediate results."""
    cols = set(columns) if columns is not None else {f.name for f in df.schema.fields
                                                     if f.dataType.typeName() == "double"}
    return df.select(*[F.bround(F.col(c), decimals).alias(c) if c in cols else F.col(c) for c in df.columns])


def training_ranges(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training min / max / mean per feature, one row (bounded size: 1)."""
    aggs = []
    for f in features:
        aggs += [F.min(f).alias(f"{f}__min"), F.max(f).alias(f"{f}__max"), F.avg(f).alias(f"{f}__mean")]
    return train.agg(*aggs)


def range_flags(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """P7 + P8: per row, red flag per feature (strictly outside the training
    range; NULL not flagged; features absent from the stats skipped), then
    ``has_red_warning`` and the flagged names in input column order.  The
    yellow outputs of the reference are never populated and stay empty."""
    known = [f for f in features if f"{f}__min" in stats.columns]
    st = stats.first()   # one row of 3·F numbers, inlined as literals
    flags = [F.coalesce((F.col(f) < F.lit(st[f"{f}__min"])) | (F.col(f) > F.lit(st[f"{f}__max"])), F.lit(False))
             for f in known]
    names = F.array_compact(F.array(*[F.when(fl, F.lit(f)) for f, fl in zip(known, flags)]))
    return df.select(*df.columns, *[fl.alias(f"red_{f}") for f, fl in zip(known, flags)],
                    (F.size(names) > 0).alias("has_red_warning"), F.lit(False).alias("has_yellow_warning"),
                    names.alias("red_warning_features"),
                    F.array().cast("array<string>").alias("yellow_warning_features"))


def range_summary(flagged: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature, flagged rows, total rows and the training range."""
    known = [f for f in features if f"red_{f}" in flagged.columns]
    st = stats.first()   # one row, inlined as literals
    per = flagged.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"red_{f}")).alias(f"n_{f}") for f in known])
    return per.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"n_{f}").alias("flagged_rows"), F.col("rows").alias("rows"),
        F.lit(st[f"{f}__min"]).cast("double").alias("train_min"), F.lit(st[f"{f}__max"]).cast("double").alias("train_max"))
        for f in known])))
