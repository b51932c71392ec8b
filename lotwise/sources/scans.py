"""Typed scans of files and annotation texts, tolerant manifests, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = (
    "crop_path string, source string, source_class string, class string, grp string, split_hint string, orig_path string, mode string, "
    "x0 double, y0 double, x1 double, y1 double, n_found int, touching int, flags string, src_md5 string, crop_md5 string, dhash string, "
    "licence string, keep int, dup_of string"
)


def path_parts(path: Column) -> dict[str, Column]:
    """Source-file columns read off a path: leaf name, class (parent folder), split (its parent), relative group."""
    parts = F.split(path, "/")
    return {
        "leaf": F.element_at(parts, -1),
        "source_class": F.try_element_at(parts, F.lit(-2)),
        "split_hint": F.try_element_at(parts, F.lit(-3)),
    }


def scan_files(spark: SparkSession, root: str, pattern: str = "*", min_bytes: int = 0) -> DataFrame:
    """Files under a folder with their path columns. The size test runs on the listing, before any content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    df = df.where(F.col("length") >= min_bytes).select("path", "length", "modificationTime")
    return df.withColumns(path_parts(F.col("path")))


def scan_annotations(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Label texts (one object per line) to one row per box; files without a usable line give no rows."""
    lines = spark.read.text(root, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    table = F.array(*[F.lit(n) for n in names])
    out = parse_box_lines(lines, "value")
    return out.withColumn("label", F.get(table, F.col("class_no"))).drop("value")


def parse_box_lines(df: DataFrame, line: str) -> DataFrame:
    """class + 4 numbers is a centre box, class + more is a polygon (its bounding box); shorter lines are dropped."""
    tok = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    df = df.withColumn("_t", tok).where(F.size("_t") >= 5)
    df = df.withColumn("_v", F.transform(F.slice("_t", F.lit(2), F.size("_t") - 1), lambda x: x.cast("double")))
    x, y, w, h = (F.get("_v", i) for i in range(4))
    xs = F.filter("_v", lambda v, i: i % 2 == 0)
    ys = F.filter("_v", lambda v, i: i % 2 == 1)
    four = F.size("_v") == 4
    return df.withColumns({
        "class_no": F.get("_t", 0).cast("int"),
        "x0": F.when(four, x - w / 2).otherwise(F.array_min(xs)), "y0": F.when(four, y - h / 2).otherwise(F.array_min(ys)),
        "x1": F.when(four, x + w / 2).otherwise(F.array_max(xs)), "y1": F.when(four, y + h / 2).otherwise(F.array_max(ys)),
    }).drop("_t", "_v")


def parse_face_lines(df: DataFrame, line: str) -> DataFrame:
    """'file: U-1, D-0' to one row per face whose flag is 1."""
    df = df.where(F.instr(line, ":") > 0)
    name = F.regexp_replace(F.trim(F.substring_index(line, ":", 1)), r"\.[^.]*$", "")
    rest = F.regexp_replace(F.expr(f"substring({line}, instr({line}, ':') + 1)"), r"\s+", "")
    faces = F.str_to_map(rest, F.lit(","), F.lit("-"))
    return df.withColumn("stem", name).select("*", F.explode(faces).alias("face", "flag")).where("flag = '1'").drop("flag")


CONTAINERS = ["trays", "items", "demos", "images", "photos"]
SRC_NAMES = ["src", "file", "image", "path", "url", "png", "jpg"]
TITLE_NAMES = ["title_en", "titleEn", "title", "name", "label", "id"]


def parse_manifest(df: DataFrame, text: str, base: str) -> DataFrame:
    """Tolerant manifest: a bare list or an object with one of several list names; entries are strings or objects
    with one of several field names. Entries without a usable source are dropped."""
    v = F.try_parse_json(text)
    lists = [F.try_variant_get("_m", f"$.{n}", "array<variant>") for n in CONTAINERS]
    df = df.withColumn("_m", v).withColumn("_l", F.coalesce(F.try_variant_get("_m", "$", "array<variant>"), *lists))
    df = df.select("*", F.posexplode("_l").alias("pos", "_e")).drop("_m", "_l")
    bare = F.schema_of_variant("_e") == "STRING"
    get = lambda names: F.coalesce(*[F.try_variant_get("_e", f"$.{n}", "string") for n in names])
    src = F.when(bare, F.try_variant_get("_e", "$", "string")).otherwise(get(SRC_NAMES))
    df = df.withColumns({"_src": src, "_title": get(TITLE_NAMES), "credit": F.coalesce(*[F.nullif(F.trim(get([n])), F.lit("")) for n in ("credit", "source", "licence", "license")]),
                         "_syn": F.try_variant_get("_e", "$.synthetic", "boolean")}).where(F.coalesce(F.col("_src"), F.lit("")) != "")
    title = F.coalesce(F.col("_title"), F.concat(F.lit("Tray "), (F.col("pos") + 1).cast("string")))
    full = F.when(F.col("_src").rlike(r"^(https?:)?/"), F.col("_src")).otherwise(F.concat(F.lit(f"{base}demo/"), F.regexp_replace("_src", r"^\.?/?(demo/)?", "")))
    guess = F.lower(F.concat_ws(" ", title, F.coalesce("credit", F.lit("")), F.col("_src"))).contains("synthetic")
    return df.withColumns({"src": full, "title": title, "synthetic": F.coalesce(F.col("_syn"), guess)}).drop("_e", "_src", "_title", "_syn")


# ---------------------------------------------------------------- typed item table and sinks

def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ITEM_SCHEMA, header=True)


def write_items_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_folds(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Fold results as one Parquet folder per fold: a rerun replaces only the folds it brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(fold).parquet(path)


def missing_folds(have: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Expected names with no data."""
    spark = have.sparkSession
    want = spark.createDataFrame([(e,) for e in expected], f"{column} string")
    return want.join(have.select(column).distinct(), column, "left_anti")


def json_report(df: DataFrame, columns: list[str], out: str = "report") -> DataFrame:
    """One JSON text per row; NaN becomes null and nulls stay visible."""
    types = dict(df.dtypes)
    safe = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if types[c] == "double" else F.col(c) for c in columns]
    return df.withColumn(out, F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
