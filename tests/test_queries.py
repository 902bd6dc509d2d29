"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(got.columns)


def test_a_symbol_whose_last_scan_has_no_sound_levels_has_no_row(spark, tmp_path):
    """The levels of its last bar are below zero; the scans before had sound ones."""
    start = pd.Timestamp("2024-01-01")
    swing = lambda user, k: 20_000.0 * (k % 2) if user == 8 and k >= 76 else 10.0 + (k % 2)
    ticks = [(start + pd.Timedelta(minutes=5 * k + user), user, "click", swing(user, k)) for user in (1, 8) for k in range(78)]
    events = pd.DataFrame(ticks, columns=["ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"})
    events.assign(event_id=range(len(events)), props="{}").to_parquet(tmp_path / "events.parquet", index=False)
    pd.read_parquet(f"{SF}/documents.parquet").to_parquet(tmp_path / "documents.parquet", index=False)
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = QUERIES["stream_live_scan"](spark, str(tmp_path)).toPandas()
    assert got["symbol"].tolist() == ["click-1"]
    assert rows(got) == rows(con.execute(ORACLES["stream_live_scan"]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
