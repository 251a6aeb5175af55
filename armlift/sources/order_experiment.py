"""An experiment log derived from the retail tables: one unit per order.

Arm, exposure and outcomes are planted by hashing the order key, so the balance,
compliance and heterogeneity of the log are known: exposure is more common for
expensive orders, and its effect is stronger for customers with a high balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armlift.functions.numeric import derive, group
from armlift.functions.units import unit_uniform

COLUMNS = ("unit_id", *(f"f{i}" for i in range(12)), "treatment", "conversion", "visit", "exposure")

# columns read; a fixed schema saves a look at the files before the job
ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CUSTOMER = "c_custkey bigint, c_nationkey int, c_acctbal double"
LINEITEM = (
    "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
)


def mean_of_cents(column: str) -> str:
    """Average of a two-decimal column through whole numbers: no order of summation."""
    return f"sum(cast(floor({column} * 100 + 0.5D) as bigint)) / 100D / count({column})"


def order_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """The raw log; f5 to f10 are null for orders without line items."""
    read = lambda table, schema: spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")
    lines = group(
        read("lineitem", LINEITEM),
        ["l_orderkey"],
        {
            "f5": "cast(count(1) as double)",
            "f6": "sum(l_quantity)",
            "f7": mean_of_cents("l_discount"),
            "f8": mean_of_cents("l_tax"),
            "f9": "max(l_extendedprice)",
            "f10": "cast(count_if(l_returnflag = 'R') as double)",
        },
    )
    orders = read("orders", ORDERS).withColumnRenamed("o_custkey", "c_custkey")
    units = (
        orders.join(read("customer", CUSTOMER), "c_custkey")
        .withColumnRenamed("o_orderkey", "l_orderkey")
        # both sides grow with the orders, so they meet by key and neither is broadcast
        .join(lines.hint("merge"), "l_orderkey", "left")
        .selectExpr(
            "l_orderkey as unit_id",
            "o_totalprice as f0",
            "cast(month(o_orderdate) as double) as f1",
            "c_acctbal as f2",
            "cast(c_nationkey as double) as f3",
            "cast(substring(o_orderpriority, 1, 1) as double) as f4",
            *[f"f{i}" for i in range(5, 11)],
            "if(l_orderkey % 50 = 0, 0D, 1D) as f11",
            "if(o_totalprice > 250000, 1D, 0D) as expensive",
            "if(c_acctbal > 5000, 1D, 0D) as rich",
        )
    )
    return planted(units).select(*COLUMNS)


def planted(units: DataFrame) -> DataFrame:
    """Add arm, exposure and outcomes by hashing the unit id."""
    arms = derive(units, {"treatment": f"if({unit_uniform('unit_id', 'arm')} < 0.85D, 1, 0)"})
    exposed = f"treatment = 1 and {unit_uniform('unit_id', 'exp')} < 0.1D + 0.3D * expensive"
    shown = derive(arms, {"exposure": f"if({exposed}, 1, 0)"})
    visit_rate = "0.04D + 0.04D * expensive + exposure * (0.1D + 0.25D * rich)"
    visits = derive(shown, {"visit": f"if({unit_uniform('unit_id', 'vis')} < {visit_rate}, 1, 0)"})
    bought = f"visit = 1 and {unit_uniform('unit_id', 'cnv')} < 0.3D"
    return derive(visits, {"conversion": f"if({bought}, 1, 0)"})
