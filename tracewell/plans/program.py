"""A program graph read off the star-schema tables: brands are types, parts methods, line items calls, orders branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROPERTIES
from .derived import table

TEXT = "string"


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Vertices with the given properties; others are null."""
    names = ["id", "label", *[p.lower() for p in PROPERTIES]]
    return df.select(*[columns.get(n, F.lit(None)).cast(TEXT).alias(n) for n in names])


def brand(column: str = "p_brand") -> Column:
    """A brand as the name of a type."""
    return F.translate(column, "# ", "__")


def method_name() -> Column:
    """A part's qualified name as a method of its brand."""
    return F.concat(F.lit("pkg."), brand(), F.lit(".m"), F.col("p_partkey").cast(TEXT))


def source_file() -> Column:
    """The file of a brand; every fifth part lies in the test folder."""
    folder = F.when(F.col("p_size") % 5 == 0, "src/__t__/java/pkg/").otherwise("src/main/java/pkg/")
    return F.concat(folder, brand(), F.lit(".java"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vertices: types, methods, calls, control structures and literals."""
    part, items, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast(TEXT))
    full = F.concat("p_brand_name", F.lit(".m"), F.col("p_partkey").cast(TEXT), F.lit(":void(int)"))
    methods = part.withColumn("p_brand_name", F.concat(F.lit("pkg."), brand()))
    out = [
        _rows(part.select("p_brand").distinct(), id=F.concat(F.lit("t"), brand()), label=F.lit("TYPE_DECL"), full_name=F.concat(F.lit("pkg."), brand()), filename=F.concat(F.lit("pkg/"), brand()), line_number=F.lit(1), line_number_end=F.lit(99)),
        _rows(methods, id=key("m", "p_partkey"), label=F.lit("METHOD"), full_name=full, name=key("m", "p_partkey"), signature=F.lit("void(int)"), filename=source_file(), line_number=F.col("p_size"), line_number_end=F.col("p_size") + 9, is_test=F.when(F.col("p_size") <= 5, "true").otherwise("false")),
        _rows(call_rows(items), id=F.col("call_id"), label=F.lit("CALL"), method_full_name=F.concat(F.lit("pkg.X.m"), F.col("l_suppkey").cast(TEXT), F.lit(":void(int)")), parent_method_id=key("m", "l_partkey"), line_number=F.col("l_linenumber"), code=F.lit("x()")),
        _rows(orders, id=key("o", "o_orderkey"), label=F.lit("CONTROL_STRUCTURE"), control_structure_type=F.when(F.col("o_orderstatus") == "F", "IF").otherwise("WHILE"), line_number=F.lit(3), code=F.col("o_orderpriority")),
    ]
    return reduce(DataFrame.union, out)


def call_rows(items: DataFrame) -> DataFrame:
    """Line items as calls, each kind of line once: (l_partkey, l_suppkey, l_linenumber, call_id)."""
    once = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return once.withColumn("call_id", F.concat_ws("_", F.concat(F.lit("c"), F.col("l_orderkey").cast(TEXT)),
        *[F.col(c).cast(TEXT) for c in ("l_linenumber", "l_partkey", "l_suppkey")]))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges (label, out_v, in_v, ord): a call calls the part with its supplier's number, an order is a branch of the part
    with its customer's number, and parts of size 7 override the part before them."""
    part, items, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    m = lambda c: F.concat(F.lit("m"), c.cast(TEXT))
    calls = call_rows(items).select(F.lit("CALL").alias("label"), F.col("call_id").alias("out_v"), m(F.col("l_suppkey")).alias("in_v"))
    tree = orders.select(F.lit("AST"), m(F.col("o_custkey")), F.concat(F.lit("o"), F.col("o_orderkey").cast(TEXT)))
    over = part.where("p_size = 7").select(F.lit("OVERRIDES"), m(F.col("p_partkey")), m(F.col("p_partkey") - 1))
    return calls.union(tree).union(over).withColumn("ord", F.lit(0).cast("long"))


#: The same in SQL: raw identifiers and names of methods.
METHODS = """pm AS (SELECT p_partkey AS k, p_size AS size, 'pkg.' || translate(p_brand, '# ', '__') || '.m' || p_partkey AS fqn,
  CASE WHEN p_size % 5 = 0 THEN 'src/__t__/java/pkg/' ELSE 'src/main/java/pkg/' END || translate(p_brand, '# ', '__') || '.java' AS file FROM part),
pc AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'c' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id FROM lineitem)"""
