"""Small text and measure columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_field(text: Column) -> Column:
    """Field without quotes; ``N/A`` becomes null."""
    return F.nullif(F.replace(text, F.lit('"'), F.lit("")), F.lit("N/A"))


def crc32_text(text: Column) -> Column:
    """CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


def content_is_text(content_type: Column) -> Column:
    """True when the content type names text; null counts as false."""
    return F.coalesce(content_type.contains("text"), F.lit(False))


def file_suffix(name: Column) -> Column:
    """Text after the last dot; null without a dot."""
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """Weighted harmonic mean of precision and recall; null when both are zero."""
    b2 = float(beta) ** 2
    return F.try_divide((1.0 + b2) * (precision * recall), b2 * precision + recall)


def f_measure(precision: Column, recall: Column) -> Column:
    """Harmonic mean of precision and recall."""
    return f_beta(precision, recall, 1.0)


def mse(predicted: Column, target: Column) -> Column:
    """Mean squared error (aggregate)."""
    return F.avg(F.pow(predicted - target, F.lit(2.0)))


def rmse(predicted: Column, target: Column) -> Column:
    """Root of the mean squared error (aggregate)."""
    return F.sqrt(mse(predicted, target))
