"""Every query with SQL gives the SQL's rows on a whole small table set; the others give rows of the schema that is written down here."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries without SQL and their columns. Those of problems are held against brute force in their own tests.
BARE = {
    "canonical_hash": "id hash",
    "itinerary": "day stops",
    "kmeans_days": "id day",
    "kmeans_per_city": "city id day",
    "p1_addresses": "id place number suffix name kind title",
    "p1_found": "id_a id_b",
    "p2_addresses": "id parent_path pos_path street postal_code locality city_fr region_fr other",
    "p2_audiences": "id parent_path pos_path label_fr label other",
    "p2_locations": "id parent_path pos_path lat lon other",
    "p2_offers": "id parent_path pos_path label label_fr other",
    "p2_periods": "id parent_path pos_path start_date end_date start_time end_time other",
    "p2_prices": "id parent_path pos_path min_price max_price currency currency_fr other",
    "p2_tables": "ancestor objects records paths values",
    "p4_links": "id class_id copies links",
    "p7_ids": "doc_id ids",
    "p8_paraphrases": "doc_id item_id lcs",
    "p9_found": "doc_id reading_level",
}


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        assert not math.isnan(v), "no number equals itself here"
        return float(f"{v:.12g}") + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = _rows(columns, cursor.fetchall())
    assert _rows(df.columns, df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == BARE[name].split() and not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
