"""Sink writers round-trip through files in a fresh scratch folder."""

import tempfile

from geoverity.operators import sinks
from geoverity.operators.merge import change_log, duplicate_coords
from geoverity.operators.validate import validate_centres

SCHEMA = ("pos long, id string, name string, address string, city string, state string, country string, "
          "postal_code string, latitude double, longitude double, confidence double")
ROWS = [(0, "a", "A", "x", "Pune", "MH", "India", "1", 18.5, 73.8, None),
        (1, "a", "B", "x", "Pune", "MH", "India", "1", 18.6, 73.8, None),
        (2, "c", "C", "y", "Agra", "UP", "India", "2", 18.5, 73.8, 0.9),
        (3, "d", "D", "z", "Agra", "UP", "Atlantis", "2", None, None, 0.1)]


def test_writers(spark):
    d = tempfile.mkdtemp(prefix="gv-sinks-", dir="/tmp")
    c = spark.createDataFrame(ROWS, SCHEMA)
    meta = sinks.save_dataset_envelope(c, f"{d}/env", "2024-01-10T00:00:00").first()
    assert meta.total_centres == 4 and meta.version == "1.0.0"
    assert spark.read.json(f"{d}/env/centres").count() == 4
    res = validate_centres(c).filter("NOT is_valid").join(c, "pos").withColumnRenamed("reason", "failure_reasons")
    sinks.failed_report(res, f"{d}/failed")
    failed = spark.read.option("header", True).csv(f"{d}/failed").collect()
    assert sorted(r.failure_reasons for r in failed) == ["duplicate_coords: (18.5, 73.8)", "duplicate_id: a",
                                                         "missing_coordinates"]
    sinks.duplicates_report(duplicate_coords(c), f"{d}/dups")
    assert spark.read.option("header", True).csv(f"{d}/dups").count() == 2
    new = spark.createDataFrame([(9, "a", "A", "x", "Pune", "MH", "India", "1", 19.0, 73.8, None)], SCHEMA)
    sinks.changes_report(change_log(c.drop("confidence"), new), f"{d}/changes")
    ch = spark.read.option("header", True).csv(f"{d}/changes").collect()
    assert [(r.field, r.old_value, r.new_value) for r in ch] == [("latitude", "18.6", "19.0")]
