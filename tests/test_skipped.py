"""Collectors that fail leave the evidence of an empty record and are named."""

from geoverity.operators import evidence as E
from geoverity.plans.geocode import CAND_FIELDS, REF_FIELDS, with_missing

INF = float("inf")

# raw record, name -> collectors that cannot read it
RAW = [("{}", "x", []), ("[1]", "x", ["geography", "place_type"]), ('"x"', "x", ["geography", "place_type"]),
       ("0", "x", []), ("null", "x", []), (None, "x", []), ("not json", "x", []), ('{"city":null}', "x", ["geography"]),
       ('{"tags":5}', "x", ["geography", "place_type"]), ('{"tags":5}', "x school", ["geography"]),
       ('{"type":"school","tags":5}', "x", []), ('{"type":7}', "x", ["geography", "place_type"]),
       ('{"properties":[]}', "x", ["place_type"]), ('{"properties":{"category":"a"}}', "x", []),
       ('{"class":null}', "x", ["place_type"]), ('{"tags":{"amenity":3}}', "x school", ["place_type"])]


def evidence(spark, rows, has_prev=None):
    cols = "pos long, cand_pos int, provider string, name string, raw string, latitude double, longitude double, ref_city string"
    cols += ", has_prev boolean, prev_latitude double, prev_longitude double, prev_name string, prev_address string"
    df = spark.createDataFrame([(*r, *(None,) * (13 - len(r))) for r in rows], cols)
    ref = [f"ref_{f}" for f in REF_FIELDS if f != "city"]
    return E.collect_evidence(E.with_raw_features(with_missing(with_missing(df, CAND_FIELDS), ref)), has_prev).collect()


def test_raw_records(spark):
    got = evidence(spark, [(i, 1, "photon", name, raw, 1.0, 2.0, "") for i, (raw, name, _) in enumerate(RAW)])
    assert {r.pos: r.skipped_collectors for r in got} == {i: want for i, (*_, want) in enumerate(RAW)}
    for r in got:
        if "place_type" in r.skipped_collectors:
            assert tuple(r.place_type) == ("unknown", 0.0, False, False, "")
        if "geography" in r.skipped_collectors:
            assert r.geography.on_land and r.geography.coordinate_precision == 0.0 and r.geography.urban_area is None


def test_infinite_coordinates(spark):
    rows = [(1, 1, "photon", "x", "{}", 1.0, 2.0, "london"), (1, 2, "photon", "x", "{}", INF, 2.0, "london"),  # after agreement
            (2, 1, "photon", "x", "{}", 1.0, 2.0, "nowhere"), (2, 2, "here", "x", "{}", INF, 2.0, "nowhere"),
            (3, 1, "photon", "x", "{}", 1.0, 2.0, "", True, -INF, 2.0, "x", "y"),
            (4, 1, "photon", "x", "{}", 1.0, 2.0, "", True, 1.0, 2.0, "x", "y"),
            (5, None, None, None, None, None, None, "")]
    got = {(r.pos, r.cand_pos): r for r in evidence(spark, rows, "has_prev")}
    skipped = {k: r.skipped_collectors for k, r in got.items()}
    assert skipped == {(1, 1): [], (1, 2): ["geography"], (2, 1): ["provider"], (2, 2): ["provider"],
                       (3, 1): ["geography", "history"], (4, 1): [], (5, None): []}
    assert got[2, 1].provider_evidence.providers_total == 0 and got[1, 1].provider_evidence.providers_total == 1
    assert not got[3, 1].historical.has_previous_data and got[4, 1].historical.matches_previous
