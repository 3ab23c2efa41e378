"""Every query with SQL gives the SQL's rows; the others give some."""

from __future__ import annotations

import random

import duckdb
import pytest

from tests.conftest import DATA, same_rows
from tidebar.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Ticks of which up to three are in the same millisecond, with other prices, at the edges of minutes too; in order of event_id, as the tables are."""
    rng, folder = random.Random(7), str(tmp_path_factory.mktemp("tied"))
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    times = sorted(rng.randrange(5 * 3600) * 1000 + rng.choice((0, 500, 999)) for _ in range(1500) for _ in range(rng.randint(1, 3)))
    times = sorted(times + [t for t in times if rng.random() < 0.5])
    con.execute("SET threads = 1")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(?::BIGINT * 1000 + 1704067200000000), 1, ?, ?, NULL)", [(i, t, rng.choice("AB"), round(rng.uniform(50, 150), 2)) for i, t in enumerate(times)])
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT PARQUET)")
    return folder, con


@pytest.mark.parametrize("name", ["candles_hourly", "latest_prices", "mtf_entries", "event_snapshots"])
def test_ticks_in_the_same_millisecond(spark, tied, name):
    """SQL's arg_min and arg_max keep the first of equals."""
    same_rows(QUERIES[name](spark, tied[0]), tied[1], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
