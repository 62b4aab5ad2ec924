"""Feature, raster, log and catalogue views derived from the star-schema tables.

Each view is one SELECT that Spark and DuckDB both run: integer arithmetic on
bigint, `DIV` for integer division (written // for DuckDB), braces around tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolith.session import bound_broadcasts, bound_disk, bound_tasks, ensure_checkpoint_dir, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages")

VIEWS: dict[str, str] = {
    "node": "SELECT p_partkey AS node_id, (p_partkey * 7919) % 4096 AS x, (p_partkey * 104729) % 4096 AS y, 198e-1 + ((p_partkey * 7919) % 4096) / 1e5 AS lon, 454e-1 - ((p_partkey * 104729) % 4096) / 1e5 AS lat FROM {part}",
    "node_tag": "SELECT p_partkey AS node_id, CASE WHEN p_size <= 12 THEN 'power' ELSE 'natural' END AS k, CASE WHEN p_size <= 10 THEN 'pole' WHEN p_size <= 12 THEN 'tower' ELSE 'tree' END AS v FROM {part} WHERE p_size <= 13",
    "way_node": "SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq, l_partkey AS node_id FROM {lineitem}",
    "way_tag": "SELECT o_orderkey AS way_id, CASE WHEN o_orderstatus = 'P' THEN 'highway' ELSE 'landuse' END AS k, CASE WHEN o_orderstatus = 'F' THEN 'farmland' WHEN o_orderstatus = 'O' THEN 'forest' WHEN o_orderpriority LIKE '1%' THEN 'motorway' WHEN o_orderpriority LIKE '2%' THEN 'primary' WHEN o_orderpriority LIKE '3%' THEN 'residential' WHEN o_orderpriority LIKE '4%' THEN 'track' ELSE 'path' END AS v FROM {orders} UNION ALL SELECT o_orderkey, 'area', CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END FROM {orders} WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'id', 'x' FROM {orders} WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'type', 'multipolygon' FROM {orders} WHERE o_orderkey % 13 = 0",
    "way_pt": "SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq, 64 + (l_orderkey * 7919) % 3968 + (l_partkey * 37) % 61 - 30 AS x, 64 + (l_orderkey * 104729) % 3968 + (l_suppkey * 53) % 61 - 30 AS y FROM {lineitem}",
    "rect": "SELECT o_orderkey AS feature_id, o_orderstatus AS status, 64 + (o_orderkey * 7919) % 3968 AS x0, 64 + (o_orderkey * 104729) % 3968 AS y0, 4 + o_orderkey % 29 AS w, 4 + (o_orderkey DIV 29) % 23 AS h FROM {orders} WHERE o_orderstatus <> 'P'",
    "relation_member": "SELECT o_custkey AS rel_id, o_orderkey AS seq, 'way' AS type, o_orderkey AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'inner' ELSE 'outer' END AS role FROM {orders} UNION ALL SELECT 1000000 + c_nationkey, c_custkey, 'relation', c_custkey, '' FROM {customer} UNION ALL SELECT 2000000 + n_regionkey, n_nationkey, 'relation', 1000000 + n_nationkey, '' FROM {nation}",
    "building": "SELECT p_partkey AS ord, p_type AS category, CAST(p_size AS BIGINT) AS width, 1 + p_partkey % 40 AS depth, CASE WHEN p_partkey % 3 > 0 THEN 'EU' ELSE 'US' END AS region FROM {part}",
    "footprint": "SELECT c_custkey AS footprint_id, 1 + c_custkey % 50 AS width, 1 + (c_custkey * 7) % 40 AS depth, c_custkey % 6 AS kind, (c_custkey * 7919) % 4096 AS x, (c_custkey * 104729) % 4096 AS y FROM {customer}",
    "emb": "SELECT CAST(vec_id AS BIGINT) AS y, embedding AS e FROM {embeddings}",
    "dem": "SELECT y, x, CAST(floor(CAST(v AS DOUBLE) * 100000) AS BIGINT) + 60000 AS v FROM {dem_flat}",
    "mask": "SELECT y, x FROM {dem} WHERE v > 68000",
    "soil": "SELECT y, x, (v DIV 4000) % 4 AS class FROM {dem}",
    "metric": "SELECT CAST(user_id AS BIGINT) AS session, event_type AS component, value AS seconds, ts FROM {events}",
    "log": "SELECT CAST(user_id AS BIGINT) AS session, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS level, ts, props AS msg FROM {events}",
    "tile_extract": "SELECT x DIV 1024 AS tile_no, 'node' AS type, node_id AS id, x DIV 1024 AS payload FROM {node} UNION ALL SELECT x DIV 1024 - 1, 'node', node_id, x DIV 1024 - 1 FROM {node} WHERE x % 1024 < 64 AND x >= 1024",
    "asset": "SELECT p_partkey AS asset_id, p_name AS name FROM {part}",
}
FLAT = {
    "spark": "SELECT y, CAST(p.pos AS BIGINT) AS x, p.col AS v FROM (SELECT y, posexplode(e) AS (pos, col) FROM {emb}) p",
    "duckdb": "SELECT y, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS x, unnest(e) AS v FROM {emb}",
}
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """The views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ensure_checkpoint_dir(spark)
        bound_broadcasts(spark)
        bound_disk(spark)
        bound_tasks(spark, sf_dir)

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        return self.over(name)

    def over(self, name: str, **tables: DataFrame) -> DataFrame:
        """A view over the given frames in place of the tables of that name."""
        text = FLAT["spark"] if name == "dem_flat" else VIEWS[name].replace(" DIV ", " div ")
        return self.spark.sql(text, **{n: tables[n] if n in tables else self(n) for n in set(_NAME.findall(text))})


def duckdb_sql(text: str) -> str:
    """Put the views that a query names in braces in front of it, as common table expressions."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in _NAME.findall(body):
            if name not in TABLES and name not in order:
                inner = FLAT["duckdb"] if name == "dem_flat" else VIEWS[name]
                need(inner)
                order.append(name)

    need(text)
    bodies = [f"{n} AS ({FLAT['duckdb'] if n == 'dem_flat' else VIEWS[n]})" for n in order]
    done = _NAME.sub(r"\1", text.strip()).replace(" DIV ", " // ")
    heads = _NAME.sub(r"\1", ",\n".join(bodies)).replace(" DIV ", " // ")
    if not bodies:
        return done
    if done[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads},\n{done[15:]}"
    return f"WITH {heads},\n{done[5:]}" if done[:5].upper() == "WITH " else f"WITH {heads}\n{done}"


class Register:
    """Collects queries and their SQL; used by the modules of this package."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(build: Callable[[Views], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
            if sql is not None:
                self.sql[name] = duckdb_sql(sql)
            return build

        return add
