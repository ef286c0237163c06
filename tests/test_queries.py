"""Every registered query with SQL against DuckDB."""

import math

import duckdb
import pytest

from mapweave.plans.oracles import ORACLES
from mapweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v is not v or (isinstance(v, float) and math.isnan(v)) else v

    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "part", "supplier"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_all_but_png_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"tile_png"}


def test_listing_orders(spark):
    got = [tuple(r) for r in QUERIES["list_layers"](spark, DATA).collect()]
    assert got == sorted(got)
    response = [(r["layer"].lower(), r["style"].lower()) for r in QUERIES["layers_response"](spark, DATA).collect()]
    assert response == sorted(response)


def test_png_holds_the_pixels(spark):
    import numpy as np

    from mapweave.sources.png import decode_rgba

    want = np.zeros((256, 256, 4), np.uint8)
    for r in QUERIES["tile_stops"](spark, DATA).toLocalIterator():
        want[r["py"], r["px"]] = r["r"], r["g"], r["b"], r["a"]
    got = QUERIES["tile_png"](spark, DATA).where("z = 8").first()
    assert got["content_type"] == "image/png"
    assert (decode_rgba(bytes(got["bytes"])) == want).all()
    assert want.any()
