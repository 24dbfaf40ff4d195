"""More of what the reviewer of the third round found: each of these failed before it was mended."""

from __future__ import annotations

import duckdb
import pytest

from thalweg.operators import flow, journeys, paths
from thalweg.plans import catalog, tables

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_calibration_adds_up_once(spark, monkeypatch):
    totals, calls = flow.totals, []
    monkeypatch.setattr(flow, "totals", lambda edges, values, **names: calls.append(names) or totals(edges, values, **names))
    assert catalog.QUERIES["calibrate_grid"](spark, DIR).count() == 6
    assert len([c for c in calls if len(c) == 6]) == 1 and len(calls) == 2  # and once for the areas


@pytest.fixture
def listed(monkeypatch):
    """How many rows each trace lists."""
    trace, counts = flow.trace, []

    def counted(edges, drops, *more):
        out = trace(edges, drops, *more)
        counts.append(out.count())
        return out

    monkeypatch.setattr(flow, "trace", counted)
    monkeypatch.setattr(journeys, "trace", counted)
    monkeypatch.setattr(paths, "trace", counted, raising=False)
    return counts


@pytest.mark.parametrize("name", ["journey_stages", "smoothed_journeys"])
def test_journeys_list_stretches(spark, duck, listed, name):
    """The rows of a journey are stretches, fewer than half of the steps."""
    assert catalog.QUERIES[name](spark, DIR).count() > 0
    assert len(listed) == 1 and listed[0] < duck.execute(f"SELECT count(*) FROM {tables.duck('{path}')} q").fetchone()[0] / 2


def test_stretches_tell_what_steps_tell(spark):
    """Two steps in one row are the same journey as two rows."""
    one = "drop_id long, step long, dist double, area double, elev double, cls int, river string, lake string, country string, destination string, destination_kind string"
    at = [(0, 0.0, 0.1, 90.0, 0), (1, 4000.0, 0.2, 80.0, 0), (2, 8000.0, 60.0, 70.0, 0), (3, 30000.0, 61.0, 60.0, 0), (4, 60000.0, 62.0, 50.0, 2), (5, 63000.0, 63.0, 40.0, 2), (6, 70000.0, 64.0, 30.0, 0), (7, 90000.0, 65.0, 20.0, 0)]
    more = lambda c, a: ("Rhine" if a > 50 else None, None, "A", "the sea", "sea")
    steps = spark.createDataFrame([(1, s, d, a, e, c, *more(c, a)) for s, d, a, e, c in at], one)
    pairs = [(1, at[i][0], at[i][1], at[i][2], at[i][3], at[i][4], *more(at[i][4], at[i][2]), at[i + 1][0], *at[i + 1][1:4]) for i in range(0, 8, 2)]
    spread = spark.createDataFrame(pairs, one + ", last long, dist_to double, area_to double, elev_to double")
    told = [sorted(map(repr, journeys.journey(rows).collect())) for rows in (steps, spread)]
    assert told[0] == told[1] and len(told[0]) > 3


def test_samples_list_stems(spark, duck, listed):
    """What is listed between samples are stems, a few a path."""
    got = catalog.QUERIES["path_resample"](spark, DIR)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE_SQL['path_resample']}) q").fetchall()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
    assert len(listed) == 1 and listed[0] < duck.execute(f"SELECT count(*) FROM {tables.duck('{path}')} q").fetchone()[0] / 2


def test_names_are_asked_of_cells(spark, duck, listed):
    """Rivers, countries and lakes are looked up a cell, and paths are listed by runs."""
    got = catalog.QUERIES["path_names"](spark, DIR)
    steps = duck.execute(f"SELECT count(*) FROM {tables.duck('{path}')} q").fetchone()[0]
    assert got.groupBy().sum("rows").first()[0] == steps
    assert len(listed) == 1 and listed[0] < steps / 2


@pytest.mark.parametrize("samples", [900, 8, 3])
def test_counts_are_those_of_steps(spark, monkeypatch, samples):
    """Also where only some steps are samples: the country of a step is that of the sample before it."""
    monkeypatch.setattr(paths, "SAMPLES", samples)
    labels = [("R", "A", None)] * 3 + [(None, "B", "L")] * 4 + [("R", None, None)] * 2 + [("S", "C", "M")] * 5 + [("S", "D", None)] * 1 + [("T", "E", "L")] * 3
    n, want, country = len(labels), {}, None
    every = max(1, n // samples)
    for s, (r, c, l) in enumerate(labels):
        asked, sample = s % 2 == 0 or s == n - 1, s % every == 0 or s == n - 1
        country = c if sample and c is not None else country
        key = (1, r if asked else None, country, l if sample else None)
        want[key] = want.get(key, 0) + 1
    runs, s = [], 0
    while s < n:
        e = s
        while e + 1 < n and labels[e + 1] == labels[s]:
            e += 1
        runs.append((1, s, e, labels[s]))
        s = e + 1
    rows = spark.createDataFrame(runs, "drop_id long, first long, last long, label struct<river:string,country:string,lake:string>")
    assert {tuple(r)[:4]: r.rows for r in paths.counted(rows).collect()} == want
