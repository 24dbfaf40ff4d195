"""Queries against their oracles on the smallest tables: a choice of them here, all by the driver."""

from __future__ import annotations

import duckdb
import pytest

from thalweg.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["d8_directions", "flow_accumulation", "trace_paths", "watershed_cells", "basin_stats", "journey_steps", "best_near", "elev_quantise", "lonlat_pixels", "tributaries_topk", "flood_fill", "strahler_order", "snap_to_river", "cell_probe", "sea_tail", "seas_near", "trace_answers", "climate_rasters", "search_places"])
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE_SQL[name]}) q").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


def test_every_query_has_a_name_and_oracles_match():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
