"""Labels, groups and licences of items before any scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def map_label(label, mapping: dict[str, str], strict: bool = True) -> Column:
    """Class of a source label; an unknown label stops the job unless ``strict`` is off."""
    c = F.col(label) if isinstance(label, str) else label
    hit = F.try_element_at(literal_map(mapping), F.lower(c))
    if not strict:
        return hit
    return F.coalesce(hit, F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("string"))


def label_from_keywords(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """Class of the first keyword, in list order, that occurs in the lower-cased text; NULL when none does."""
    low = F.lower(text)
    out = None
    for word, cls in keywords:
        hit = low.contains(word)
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out


def exclusive_label(labels: Column, neutral: str, classes: dict[str, str], clean: str = "healthy") -> Column:
    """Class of a label set without its neutral label: one known label -> its class, none -> clean, else NULL."""
    rest = F.array_except(F.array_distinct(labels), F.array(F.lit(neutral)))
    one = F.when(F.size(rest) == 1, F.try_element_at(literal_map(classes), F.element_at(rest, 1)))
    return F.when(F.size(rest) == 0, clean).otherwise(one)


def relabel_pairs(source: Column, label: Column, kind: Column, pairs: list[tuple], to: str) -> Column:
    """Kind replaced for the listed (source, label) pairs."""
    hit = F.lit(False)
    for s, v in pairs:
        hit = hit | ((source == s) & (label == v))
    return F.when(hit, to).otherwise(kind)


def capture_group(source: Column, twins: dict[str, str]) -> Column:
    """Sibling sources (same set-up) share one group; others keep their own name."""
    return F.coalesce(F.try_element_at(literal_map(twins), source), source)


def licence_split(items: DataFrame, registry: DataFrame, source: str, licensed: Column) -> DataFrame:
    """Adds role: 'train' for items of sources that state a licence, 'test_only' for the rest."""
    reg = registry.select(source, licensed.alias("_lic"))
    return (
        items.join(reg, source, "left")
        .withColumn("role", F.when(F.coalesce(F.col("_lic"), F.lit(False)), "train").otherwise("test_only"))
        .drop("_lic")
    )


def group_from_name(url: Column) -> Column:
    """Capture group from a file name: the leaf without query, fragment and extension; the leaf itself if nothing is left."""
    leaf = F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
    base = F.regexp_extract(leaf, r"^([A-Za-z0-9_-]+)([.?#].*)?$", 1)
    return F.when(base == "", leaf).otherwise(base)
