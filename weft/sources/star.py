"""The business tables as a property graph, so that every graph operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, containment
from ..ontology import STAR
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Star:
    """Nodes and edges by kind; each is a plan over the tables that it needs and no other."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    # ids
    def nations(self) -> DataFrame:
        # 25 rows joined to 5 at every scale.
        return self.table("nation").join(
            F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("nation_id"))

    def customers(self) -> DataFrame:
        return self.table("customer").join(
            F.broadcast(self.nations()), F.col("c_nationkey") == F.col("n_nationkey")
        ).select("c_custkey", F.concat_ws(".", "nation_id", "c_name").alias("customer_id"))

    def suppliers(self) -> DataFrame:
        return self.table("supplier").join(
            F.broadcast(self.nations()), F.col("s_nationkey") == F.col("n_nationkey")
        ).select("s_suppkey", F.concat_ws(".", "nation_id", "s_name").alias("supplier_id"))

    def parts(self) -> DataFrame:
        return self.table("part").select(
            "p_partkey", F.concat(F.lit("catalog."), "p_brand", F.lit(".P"), F.col("p_partkey").cast("string")).alias("part_id"),
            F.concat(F.lit("catalog."), "p_brand").alias("brand_id")
        )

    def orders(self) -> DataFrame:
        joined = self.table("orders").join(self.customers(), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            "o_orderkey", F.concat("customer_id", F.lit(".O"), F.col("o_orderkey").cast("string")).alias("order_id")
        )

    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            "conv_id", "turn",
            F.concat(F.lit("conv."), F.col("conv_id").cast("string"), F.lit(".t"), F.col("turn").cast("string")).alias("turn_id")
        )

    # nodes
    def labelled(self, *kinds: str) -> DataFrame:
        """``id, label`` rows of the kinds asked for, all by default."""
        made = {
            "Region": lambda: self.table("region").select(F.col("r_name").alias("id")),
            "Nation": lambda: self.nations().select(F.col("nation_id").alias("id")),
            "Customer": lambda: self.customers().select(F.col("customer_id").alias("id")),
            "Supplier": lambda: self.suppliers().select(F.col("supplier_id").alias("id")),
            "Order": lambda: self.orders().select(F.col("order_id").alias("id")),
            "Catalog": lambda: self.spark.range(1).select(F.lit("catalog").alias("id")),
            "Brand": lambda: self.parts().select(F.col("brand_id").alias("id")).distinct(),
            "Part": lambda: self.parts().select(F.col("part_id").alias("id")),
            "EventType": lambda: self.table("events").select(F.col("event_type").alias("id")).distinct(),
            "Turn": lambda: self.turns().select(F.col("turn_id").alias("id")),
            "Page": lambda: self.table("pages").select(F.concat(F.lit("page."), F.col("page_id").cast("string")).alias("id")),
            "Url": lambda: self.links().select(F.col("dst").alias("id")).distinct(),
        }
        rows = [made[k]().withColumn("label", F.lit(k)) for k in (kinds or made)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def nodes(self, *kinds: str) -> DataFrame:
        empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        return self.labelled(*kinds).select("id", F.array("label").alias("labels"), empty.alias("props"))

    # edges
    def _edges(self, rows: DataFrame, rel: str, source: str | None) -> DataFrame:
        empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        return rows.select(
            "src", F.lit(rel).alias("rel"), "dst", "chunk_id", F.lit(1.0).alias("confidence"),
            F.lit(source).cast("string").alias("source"), empty.alias("props")
        )

    def defined_in(self, *kinds: str) -> DataFrame:
        kinds = kinds or ("Region", "Nation", "Customer", "Supplier", "Order", "Catalog", "Brand", "Part")
        return self._edges(
            containment(self.labelled(*kinds).select("id")).withColumn("chunk_id", F.col("src")), "DEFINED_IN", "ast"
        )

    def _evidence(self) -> F.Column:
        return F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id")

    def supplies(self) -> DataFrame:
        """One edge per key: lines repeat, so their keys are made distinct before names are joined and anything is counted."""
        keys = ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
        return self._supplies(spread(self.table("lineitem").select(*keys), *keys).distinct())

    def supply_writes(self) -> DataFrame:
        """A SUPPLIES edge for each line: a key may repeat, for a write that keeps the last of each."""
        return self._supplies(self.table("lineitem"))

    def _supplies(self, lines: DataFrame) -> DataFrame:
        rows = lines.join(self.suppliers(), F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.join(self.parts(), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.select(F.col("supplier_id").alias("src"), F.col("part_id").alias("dst"), self._evidence())
        return self._edges(rows, "SUPPLIES", "ast")

    def contains(self) -> DataFrame:
        keys = ("l_partkey", "l_orderkey", "l_linenumber")
        lines = spread(self.table("lineitem").select(*keys), *keys).distinct()
        rows = lines.join(self.orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.join(self.parts(), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.select(F.col("order_id").alias("src"), F.col("part_id").alias("dst"), self._evidence())
        return self._edges(rows, "CONTAINS", "ast")

    def next_events(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        rows = self.table("events").select(
            "user_id", "ts", "event_id", "event_type"
        ).withColumn("before", F.lag("event_type").over(w)).where("before is not null")
        return self._edges(
            rows.select(
                F.col("before").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").cast("string").alias("chunk_id")
            ),
            "NEXT", None
        )

    def transitions(self) -> DataFrame:
        """NEXT without its evidence: one edge per pair of event types, at most 25 at any scale."""
        return self._edges(
            self.next_events().select("src", "dst").distinct().withColumn("chunk_id", F.concat_ws(">", "src", "dst")), "NEXT", None
        )

    def replies(self) -> DataFrame:
        t = self.turns()
        before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn_id").alias("dst"))
        return self._edges(
            t.join(before, ["conv_id", "turn"]).select(F.col("turn_id").alias("src"), "dst", F.col("turn_id").alias("chunk_id")),
            "REPLIES", "ast"
        )

    def links(self) -> DataFrame:
        pages = self.table("pages").select(
            "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
        )
        rows = pages.select(
            F.concat(F.lit("page."), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("url:"), "href").alias("dst")
        ).distinct()
        return self._edges(rows.withColumn("chunk_id", F.col("src")), "LINKS", "llm")

    def edges(self, *rels: str) -> DataFrame:
        made = {
            "DEFINED_IN": self.defined_in, "SUPPLIES": self.supplies, "CONTAINS": self.contains, "NEXT": self.next_events,
            "REPLIES": self.replies, "LINKS": self.links
        }
        rows = [made[r]() for r in (rels or made)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def graph(self, kinds: tuple[str, ...] = (), rels: tuple[str, ...] = ()) -> PropertyGraph:
        return PropertyGraph(self.nodes(*kinds), self.edges(*rels), STAR)

    def places(self) -> PropertyGraph:
        """Regions, nations, customers and suppliers with their containment."""
        kinds = ("Region", "Nation", "Customer", "Supplier")
        return PropertyGraph(self.nodes(*kinds), self.defined_in(*kinds), STAR)
