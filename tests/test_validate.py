"""V2 against a direct sequential model of the rule (first failing check wins;
duplicates only of rows accepted earlier)."""

import random

from geoverity import constants as K
from geoverity.operators.validate import validate_centres

LAND = [(12.97, 77.59), (28.61, 77.2), (51.5, -0.12), (40.7, -74.0)]


def sequential(rows):
    seen_ids, seen_coords, out = set(), set(), {}
    for pos, cid, lat, lon, country, conf in rows:
        if lat is None or lon is None:
            out[pos] = (False, "missing_coordinates")
            continue
        if not any(a <= lat <= c and b <= lon <= d for a, b, c, d in K.CONTINENT_BOXES.values()):
            out[pos] = (False, "ocean_coordinates")
            continue
        if country and country.upper() not in ("INDIA", "US", "UK"):
            out[pos] = (False, f"wrong_country: {country}")
            continue
        if cid and cid in seen_ids:
            out[pos] = (False, f"duplicate_id: {cid}")
            continue
        if (lat, lon) in seen_coords:
            out[pos] = (False, f"duplicate_coords: {(lat, lon)}")
            continue
        if conf is not None and conf < 0.6:
            out[pos] = (False, f"low_confidence: {conf:.2f}")
            continue
        out[pos] = (True, None)
        if cid:
            seen_ids.add(cid)
        seen_coords.add((lat, lon))
    return out


def test_example_from_docs(spark):
    rows = [(0, "id1", 12.97, 77.59, "India", None), (1, "id1", 28.61, 77.2, "India", None),
            (2, "id2", 28.61, 77.2, "India", None), (3, "id3", -20.0, 60.0, "India", None),
            (4, "id4", 51.5, -0.12, "Atlantis", None), (5, "id5", None, None, "India", None),
            (6, "id6", 40.7, -74.0, "US", 0.5), (7, "id7", 40.7, -74.0, "US", 0.9)]
    df = spark.createDataFrame(rows, "pos long, id string, latitude double, longitude double, "
                                     "country string, confidence double")
    got = {r.pos: (r.is_valid, r.reason) for r in validate_centres(df).collect()}
    assert got == sequential(rows)
    assert got[2] == (True, None)          # B was rejected, so C is not a duplicate
    assert got[1] == (False, "duplicate_id: id1")
    assert got[6] == (False, "low_confidence: 0.50")


def test_random_against_sequential(spark):
    rnd = random.Random(7)
    rows = []
    for pos in range(400):
        cid = rnd.choice(["", "a", "b", "c", "d", "e", f"u{pos}"])
        lat, lon = rnd.choice(LAND + [(None, None), (-20.0, 60.0)])
        conf = rnd.choice([None, 0.3, 0.9])
        country = rnd.choice(["India", "US", "", "Atlantis"])
        rows.append((pos, cid, lat, lon, country, conf))
    df = spark.createDataFrame(rows, "pos long, id string, latitude double, longitude double, "
                                     "country string, confidence double")
    got = {r.pos: (r.is_valid, r.reason) for r in validate_centres(df).collect()}
    assert got == sequential(rows)


def _rows(rows, spark, **more):
    df = spark.createDataFrame(rows, "pos long, id string, latitude double, longitude double, country string, confidence double")
    return {r.pos: (r.is_valid, r.reason) for r in validate_centres(df, **more).collect()}


def test_components_and_rounds(spark):
    """Components decided by one task, and by rounds, equal the sequential rule."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["", *map(str, range(60))]), rng.choice(LAND)[0] + rng.randrange(40) / 1000, 77.0 if rng.random() < .8 else 77.5,
             "India", rng.choice([None, None, 0.9, 0.1])) for i in range(500)]
    want = {p: (ok, r) for p, (ok, r) in sequential(rows).items()}
    assert _rows(rows, spark, rounds=0) == want
    assert _rows(rows, spark, rounds=1) == want
    assert _rows(rows, spark, rounds=0, max_component=1) == want


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each row conflicts with the one before, by id and by coordinates in turn: rounds stay logarithmic."""
    from geoverity.operators import components as C
    n, calls = 5000, []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda df: (calls.append(1), plain(df))[1])
    rows = [(i, f"c{(i + 1) // 2}", 12.0 + (i // 2) * 1e-5, 77.0, "India", None) for i in range(n)]
    got = _rows(rows, spark)
    assert got == {p: (ok, r) for p, (ok, r) in sequential(rows).items()}
    assert len(calls) < 25
