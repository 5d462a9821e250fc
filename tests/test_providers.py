"""Provider payload parsers on hand-written responses."""

import json

from geoverity.sources import providers as P


def _df(spark, provider, payload):
    return spark.createDataFrame([("q", provider, json.dumps(payload))], "query string, provider string, payload string")


def test_nominatim(spark):
    item = {"display_name": " Legacy School , Bangalore, India", "lat": "12.97", "lon": "77.59", "importance": 0.9,
            "address": {"house_number": "12", "road": "MG Road", "neighbourhood": "Ashok", "town": "Bangalore",
                        "state": "KA", "country": "India"}}
    r = P.parse_nominatim(_df(spark, "nominatim", [item])).collect()[0]
    assert r.name == "Legacy School" and r.address == "12, MG Road, Ashok" and r.city == "Bangalore"
    assert (r.latitude, r.longitude, r.confidence) == (12.97, 77.59, 1.0)


def test_photon_and_geoapify(spark):
    fc = {"features": [{"geometry": {"coordinates": [77.5, 12.9]},
                        "properties": {"name": "A", "street": "S", "suburb": "X", "city": "", "town": "T",
                                       "score": 0.3, "formatted": "A, S", "rank": {"confidence": 0.7}}}]}
    r = P.parse_photon(_df(spark, "photon", fc)).collect()[0]
    assert (r.latitude, r.longitude, r.address, r.city, r.confidence) == (12.9, 77.5, "S, X", "", 0.3)
    g = P.parse_geoapify(_df(spark, "geoapify", fc)).collect()[0]
    assert g.address == "A, S" and g.confidence == 0.7
    assert P.parse_geoapify(_df(spark, "geoapify", fc), api_key_present=False).count() == 0


def test_overpass(spark):
    els = {"elements": [{"lat": 0, "center": {"lat": 1.5, "lon": 2.5}, "lon": 3.0,
                         "tags": {"name": "N", "addr:country": "in", "addr:street": "St"}},
                        {"lat": 5.0, "lon": 6.0, "tags": {"addr:country": "ZZ"}}] + [{"lat": 1.0}] * 5}
    rows = P.parse_overpass(_df(spark, "overpass", els)).orderBy("cand_rank").collect()
    assert len(rows) == 5
    assert (rows[0].latitude, rows[0].longitude, rows[0].country, rows[0].address) == (1.5, 3.0, "India", "St")
    assert rows[1].country == "ZZ" and rows[1].confidence == 0.4
