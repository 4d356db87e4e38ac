"""Every registered query runs, and agrees with its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from terraflux.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
#: The heaviest, checked by their own tests and on larger tables.
SLOW = {"horse_race", "distance_variants_wide"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_against_duckdb(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    theirs = sorted(duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.oracle_sql()[name]})").fetchall(), key=str)
    assert mine == theirs and mine


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql() and n not in SLOW])
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_sums(spark, sf, tmp_path):
    from terraflux.streaming.flows import upserts, windowed_sums

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    batch = windowed_sums(events, "ts", ("event_type",), "value")
    stream = windowed_sums(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", ("event_type",), "value")
    q = upserts(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= batch.count()
