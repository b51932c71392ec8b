"""The given tables with explicit schemas, and the item / score / vector / document views made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ),
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.read(name)
        raise AttributeError(name)

    def lots(self) -> DataFrame:
        """Line items as called items of a lot: code 0 good, 1 defect, 2 unsure."""
        return self.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"),
            F.col("l_suppkey").alias("lot"),
            F.col("l_orderkey").alias("photo"),
            (F.col("l_suppkey") % 12).alias("source"),
            F.when(F.round(F.col("l_tax") * 100) >= 8 - F.col("l_suppkey") % 3, 2)
            .when(F.round(F.col("l_discount") * 100) >= 10 - F.col("l_suppkey") % 8, 1)
            .otherwise(0).alias("code"),
            (F.col("l_quantity") >= 49).alias("touching"),
            F.year("l_shipdate").alias("year"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_partkey").alias("part"),
            F.col("l_linenumber").alias("line"),
            F.col("l_returnflag").alias("flag"),
        )

    def items(self) -> DataFrame:
        """Line items as components of a photo (one supplier and year): area, colour, box and shape columns."""
        pk, lot = F.col("part"), F.col("lot")
        r = (40.0 + (pk * 37) % 200) * F.when(lot % 5 == 0, 0.3).otherwise(1.0)
        area = F.when(lot % 10 == 0, F.col("price") / 200 + 60).otherwise(F.col("price") / 100)
        x0, y0 = (pk * 13) % 90, (pk * 29) % 90
        return self.lots().select(
            "item", "lot", "source", "year", "code",
            (lot * 10000 + F.col("year")).alias("photo"),
            area.alias("area"),
            r.alias("r"),
            (r * (70 + pk % 30) / 100).alias("g"),
            (r * (40 + (pk * 7) % 60) / 100).alias("b"),
            (F.col("discount") * 2.5 + 0.75).alias("solidity"),
            (F.col("tax") * 2.5 + 0.8).alias("fill"),
            F.when(lot % 10 == 0, F.col("qty") / 60 + 1.2).otherwise(F.col("qty") / 25 + 1).alias("elong"),
            (F.col("qty") >= 47).alias("touching"),
            x0.alias("x0"), y0.alias("y0"),
            (x0 + F.sqrt(area)).alias("x1"), (y0 + F.sqrt(area)).alias("y1"),
            "part", "flag", "qty",
        )

    def scores(self) -> DataFrame:
        """Events as scored items: P(good), the truth and the source."""
        return self.events.select(
            "event_id", "ts", F.col("user_id").alias("user"), (F.col("user_id") % 7).alias("source"),
            F.col("event_type").alias("kind"), "value",
            (1 / (1 + F.exp((F.col("value") - 50) / 25))).alias("p_good"),
            F.col("event_type").isin("error", "signup").cast("int").alias("defect"),
            (F.get_json_object("props", "$.k").cast("int") >= 95).alias("touching"),
        )

    def emb(self) -> DataFrame:
        """Vectors as items: six logits, the class (-1: defect of no stated type), 16 shape statistics."""
        e = F.transform("embedding", lambda x: x.cast("double"))
        lab = F.col("label")
        return self.embeddings.select(
            "vec_id", e.alias("e"), "label",
            F.when(lab < 4, 0).when(lab < 9, lab - 3).otherwise(-1).alias("y"),
            (F.col("vec_id") % 5).alias("source"),
            (F.col("vec_id") % 25).alias("photo"),
            F.transform(F.slice(e, 1, 6), lambda x: x * 12).alias("logits"),
            F.slice(e, 1, 16).alias("hand"),
        )

    def docs(self) -> DataFrame:
        """Documents as source files: content hash, crop hash, source order."""
        return self.documents.select(
            "doc_id", "text", "lang", "source", "n_chars",
            F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_no"),
            F.md5("text").alias("m"),
            F.md5(F.regexp_replace("text", r"[ \n\t]+", " ")).alias("c"),
        )


# The same views for the SQL twins.
LOTS = """lots AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item, l_suppkey AS lot, l_orderkey AS photo,
 l_suppkey % 12 AS source, CASE WHEN round(l_tax*100) >= 8 - l_suppkey%3 THEN 2 WHEN round(l_discount*100) >= 10 - l_suppkey%8 THEN 1 ELSE 0 END AS code,
 l_quantity >= 49 AS touching, CAST(year(l_shipdate) AS INTEGER) AS year, l_shipdate AS ts, l_quantity AS qty, l_extendedprice AS price,
 l_discount AS discount, l_tax AS tax, l_partkey AS part, l_linenumber AS line, l_returnflag AS flag FROM lineitem)"""

ITEMS = LOTS + """, items0 AS (SELECT item, lot, source, year, code, lot*10000+year AS photo,
 CASE WHEN lot%10=0 THEN price/200+60 ELSE price/100 END AS area, (40.0e0 + (part*37)%200) * (CASE WHEN lot%5=0 THEN 0.3e0 ELSE 1.0e0 END) AS r,
 discount*2.5e0+0.75e0 AS solidity, tax*2.5e0+0.8e0 AS fill, CASE WHEN lot%10=0 THEN qty/60+1.2e0 ELSE qty/25+1 END AS elong,
 qty >= 47 AS touching, (part*13)%90 AS x0, (part*29)%90 AS y0, part, flag, qty FROM lots),
 items AS (SELECT *, r * (70 + part%30) / 100 AS g, r * (40 + (part*7)%60) / 100 AS b, x0+sqrt(area) AS x1, y0+sqrt(area) AS y1 FROM items0)"""

SCORES = """scores AS (SELECT event_id, ts, user_id AS "user", user_id % 7 AS source, event_type AS kind, value,
 1/(1+exp((value-50)/25)) AS p_good, CASE WHEN event_type IN ('error','signup') THEN 1 ELSE 0 END AS defect,
 CAST(json_extract_string(props, '$.k') AS INTEGER) >= 95 AS touching FROM events)"""

EMB = """emb0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, CASE WHEN label < 4 THEN 0 WHEN label < 9 THEN label-3 ELSE -1 END AS y,
 vec_id % 5 AS source, vec_id % 25 AS photo FROM embeddings), emb1 AS (SELECT *, list_transform(e[1:6], lambda x: x*12) AS logits, e[1:16] AS hand FROM emb0),
 emb2 AS (SELECT *, list_max(logits) AS mx FROM emb1), emb3 AS (SELECT *, list_transform(logits, lambda x: exp(x - mx)) AS ex FROM emb2),
 emb AS (SELECT vec_id, e, label, y, source, photo, logits, hand, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM emb3)"""

DOCS = """docs AS (SELECT doc_id, text, lang, source, n_chars, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS source_no,
 md5(text) AS m, md5(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) AS c FROM documents)"""
