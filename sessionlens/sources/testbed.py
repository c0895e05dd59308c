"""Session tables derived from the generic star-schema and event tables used for checks.

events      -> clicks / carts / orders; a session is a user within a ten-day period
              (validation split: days 20-26 are the test week, days 27-29 hold the labels)
baskets     -> a customer's line items, one long session per customer
vectors     -> item vectors
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.config import DAY_MS

TEST_DAYS = (20, 26)
LABEL_DAYS = (27, 29)
EVENT_TYPE = {"view": "clicks", "click": "clicks", "signup": "carts", "purchase": "orders"}
RETURN_FLAG = {"N": "clicks", "A": "carts", "R": "orders"}


def _millis(column: str):
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone."""
    span = F.col(column) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(span.cast("interval second").cast("decimal(20,6)") * 1000).cast("long")


def _renamed(column: str, names: dict[str, str]):
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return table[F.col(column)]


@dataclass(frozen=True)
class Testbed:
    spark: SparkSession
    root: str

    __test__ = False

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def events(self) -> DataFrame:
        local_start = "datediff(cast(ts + interval 2 hours as date), date'2024-01-01')"
        return (
            self._table("events")
            .filter(F.col("event_type").isin(*EVENT_TYPE))
            .select(
                "user_id",
                _renamed("event_type", EVENT_TYPE).alias("type"),
                F.get_json_object("props", "$.k").cast("long").alias("aid"),
                _millis("ts").alias("ts"),
                F.expr(local_start).cast("long").alias("day"),
            )
            .select(
                (F.col("user_id") * 10 + F.floor(F.col("day") / 10)).alias("session"),
                "aid",
                "ts",
                "type",
                "day",
            )
        )

    def interactions(self) -> DataFrame:
        """The whole log, label days included."""
        return self.events().drop("day")

    def train(self) -> DataFrame:
        return self.events().filter(~F.col("day").between(*LABEL_DAYS)).drop("day")

    def test(self) -> DataFrame:
        return self.events().filter(F.col("day").between(*TEST_DAYS)).drop("day")

    def labels(self) -> DataFrame:
        rows = self.events().filter(F.col("day").between(*LABEL_DAYS))
        return rows.select("session", "type", "aid").distinct()

    def nested_labels(self) -> DataFrame:
        """Label lists. A list covers a range of 1000 item ids, so no list grows with the data."""
        return (
            self.labels()
            .groupBy("session", "type", F.floor(F.col("aid") / 1000).alias("part"))
            .agg(F.struct(F.collect_list(F.struct(F.col("aid").alias("item"))).alias("list")).alias("ground_truth"))
            .drop("part")
        )

    def baskets(self) -> DataFrame:
        orders = self._table("orders").select("o_orderkey", "o_custkey")
        lines = self._table("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("session"),
            F.col("l_partkey").alias("aid"),
            _millis("l_shipdate").alias("ts"),
            _renamed("l_returnflag", RETURN_FLAG).alias("type"),
        )

    def vectors(self) -> DataFrame:
        return self._table("embeddings").select(F.col("vec_id").alias("aid"), F.col("embedding").alias("vector"))


BASKET_WINDOW_MS = 90 * DAY_MS
