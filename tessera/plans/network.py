"""Queries over the support graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import network as op
from tessera.plans import adapters as ad

EDGES = """
edges AS (SELECT DISTINCT o.o_custkey AS source, l.l_suppkey AS target FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R'),
s AS (SELECT s_suppkey AS node, s_acctbal < 0 AS rejected, coalesce(n, 0)::BIGINT AS support FROM supplier LEFT JOIN (SELECT target, count(*) AS n FROM edges GROUP BY 1) ON target = s_suppkey)
"""


def entity_support_positions(spark, sf_dir):
    out = op.positions(ad.supplier_nodes(spark, sf_dir), ad.support_edges(spark, sf_dir))
    return out.select("node", "support", "dense_rank", "below", "total", out.position.cast("double").alias("position"))


def ordered_fingerprints(spark, sf_dir):
    """The address of all customers in order of their balance."""
    c = ad.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    return op.ordered_fingerprint(c, [F.desc("c_acctbal"), F.asc("c_custkey")], "c_custkey", "c_name")


QUERIES = [
    (
        "ordered_fingerprints",
        ordered_fingerprints,
        f"""WITH d AS (SELECT sha256('{{"_place":' || row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) || ',"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}') AS d FROM customer) SELECT {ad.fingerprint_sql("d")} AS fingerprint FROM d""",
    ),
    (
        "entity_support_positions",
        entity_support_positions,
        f"""WITH {EDGES}
        SELECT node, support, dense_rank() OVER (ORDER BY support DESC)::BIGINT AS dense_rank,
          (rank() OVER (ORDER BY support) - 1)::BIGINT AS below, (count(*) OVER ())::BIGINT AS total,
          round((2000000 * (rank() OVER (ORDER BY support) - 1) + count(*) OVER () - 1) // (2 * (count(*) OVER () - 1)) / 1000000, 6)::DOUBLE AS position FROM s""",
    ),
]
