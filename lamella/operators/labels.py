"""Cell classes of crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.constants import CLASS_MAP, UNKNOWN


def clean_metadata(rows: DataFrame) -> DataFrame:
    """(crop_index, classes) by whole index; rows without a whole number are skipped, the last of equals wins."""
    index = F.expr("try_cast(trim(crop_index) as int)")
    known = rows.select(index.alias("crop_index"), "classes", "ordinal").where("crop_index is not null")
    return known.groupBy("crop_index").agg(F.max_by("classes", "ordinal").alias("classes"))


def consolidate(df: DataFrame, raw: str, name: str = "cell_class", normalise: bool = False) -> DataFrame:
    """Adds the consolidated class of a raw name; names without one stay. ``normalise`` also joins classes that differ by case alone."""
    pairs = F.create_map(*[F.lit(x) for pair in CLASS_MAP.items() for x in pair])
    mapped = F.coalesce(F.try_element_at(pairs, F.coalesce(F.col(raw), F.lit(""))), F.col(raw))
    if normalise:
        mapped = F.when(F.lower(mapped) == "t cells", "T cells").otherwise(mapped)
    return df.withColumn(name, mapped)


def class_or_unknown(crops: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each crop's class, or the name for unknown ones; metadata is (crop_index, cell_class)."""
    return crops.select("crop_index").distinct().join(metadata, "crop_index", "left").select("crop_index", F.coalesce("cell_class", F.lit(UNKNOWN)).alias("cell_class"))
