"""Every registered query against its SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from cartolith.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    order = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in frame.collect())
    if name not in SQL:
        assert got
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == order
    at = [found.columns.index(c) for c in order]
    want = sorted(tuple(cell(r[k]) for k in at) for r in found.fetchall())
    assert got == want


#: Queries over the grid, with the literals of their SQL that hold for 500 rows and what they are for 560.
TALL = {
    "RAS_10_relief": {}, "RAS_10_gradient": {}, "AGG_29_local_majority": {}, "AGG_13_station_window_mean": {}, "RAS_09_normalised_convolution": {}, "AGG_30_border_mode": {}, "RAS_03_erosion": {},
    "RAS_01_resize_nearest": {"500": "560"}, "RAS_02_quarter_rotation": {"499": "559"}, "RAS_05_blur": {"499": "559", "998": "1118"}, "RAS_22_ground_cover": {"498": "558"},
    "RAS_19_centre_cut": {"150": "180", "349": "379"}, "RAS_27_validate_grid": {"32000": "35840"}, "JOB_06_soil_share": {"32000e0": "35840e0"}, "JOIN_12_elevation_at_points": {"499": "559"},
    "MESH_01_faces": {"62": "69"}, "MESH_02_affine": {"499": "559"}, "MESH_03_ground_uv": {"496e0": "552e0"}, "MESH_04_quadrants": {"62": "69", "248": "276"},
    "AGG_16_nonzero_bounds": {"499": "559"}, "RAS_04_dilation": {"499": "559"}, "RAS_08_edge_rim": {"499": "559"}, "POLY_10_opening": {"499": "559"},
}


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """A folder with a grid of 560 rows, and DuckDB over it."""
    path, found = tmp_path_factory.mktemp("tall"), duckdb.connect()
    for name, rows in (("embeddings", "vec_id < 560"), ("customer", "true")):
        found.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/{name}.parquet' WHERE {rows}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), found


@pytest.mark.parametrize("name", sorted(TALL))
def test_grid_query_covers_all_rows(spark, tall, name):
    text = SQL[name]
    for old, new in TALL[name].items():
        assert re.search(rf"\b{old}\b", text)
        text = re.sub(rf"\b{old}\b", new, text)
    frame = QUERIES[name](spark, tall[0])
    order = sorted(frame.columns)
    rows = lambda found: sorted(tuple(cell(x) for x in r) for r in found)
    assert rows(frame.select(*order).collect()) == rows(tall[1].sql(text).select(*order).fetchall())
