"""The city dimension is broadcast only up to its stated size."""

import pytest

from hireframe.operators import listings as L


def test_city_table_beyond_its_bound(spark, monkeypatch):
    cities = spark.createDataFrame([("武汉市", "湖北省", 1), ("宜昌市", "湖北省", 2), ("长沙市", "湖南省", 3)], "short_name string, full_name string, ord int")
    places = spark.createDataFrame([("武汉",), ("长沙市-岳麓区",)], "location string")
    found = {r["location"]: r["province"] for r in L.match_provinces(places, cities).collect()}
    assert found == {"武汉": "湖北省", "长沙市-岳麓区": "湖南省"}
    monkeypatch.setattr(L, "MOST_CITIES", 2)
    with pytest.raises(ValueError):
        L.match_provinces(places, cities)
