"""Registered queries: raw record sources, normalisation, schema reshaping and
sink-shaped outputs. Stand-in raw documents are built row by row from the
centres table in the layouts the sources accept (a list with a vendor-keyed
object; an object holding a list of generic-keyed objects; a header+rows table),
so every source path and every normalisation rule runs on data that grows with
the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import normalize as N
from ..operators import reshape as X
from ..session import ensure_checkpoint_dir
from ..sources import ranges as G
from ..sources import records as R
from ..sources.tables import read_table
from ..streaming.ingest import current_dataset, start_ingest
from . import inputs
from .registry import r6, register

NORMALIZED_AT = "2024-01-10T00:00:00"

# the reshaping target used by the registered query (a user's sample record)
SAMPLE_OUTPUT = {
    "id": "A-17",
    "centre_name": "Riverside College",
    "address": {"city": "Pune", "zip": "411001"},
    "location": {"lat": 18.52, "lng": 73.85},
    "latitude": 18.52,
    "links": {"map": "https://maps.example.org/view?at=18.5204,73.8567&zoom=9"},
    "TestCenterCode": "A17",
    "type": "school",
}


def raw_documents(spark, sf):
    c = inputs.centres(spark, sf)
    lat_v = F.when(F.col("pos") % 10 == 3, F.lit(0.0)).otherwise(F.col("latitude"))
    vendor = F.to_json(F.array(F.struct(
        F.col("id").alias("TestCenterCode"), F.col("name").alias("TestCenterName"),
        F.col("address").alias("Address1"), F.col("city").alias("City"), F.col("state").alias("State"),
        F.col("country").alias("Country"), F.col("postal_code").alias("ZipCode"),
        lat_v.alias("Latitude"), F.col("longitude").cast("string").alias("Longitude"))))
    generic = F.to_json(F.struct(
        F.struct(F.lit(1).alias("page")).alias("meta"),
        F.array(F.struct(F.concat(F.lit("  "), F.col("name"), F.lit("   ")).alias("School Name"),
                         F.col("city").alias("town"), F.col("state").alias("province"),
                         F.col("country").alias("nation"), F.col("latitude").alias("lat"),
                         F.col("longitude").alias("lng"))).alias("data")))
    table = F.to_json(F.array(F.array(
        F.array(*[F.lit(k) for k in ["code", "name", "city", "country", "zip"]]),
        F.array(F.col("id"), F.col("name"), F.col("city"), F.col("country"), F.col("postal_code")))))
    text = F.when(F.col("pos") % 3 == 0, vendor).when(F.col("pos") % 3 == 1, generic).otherwise(table)
    return c.select(F.col("pos").alias("doc_id"), text.alias("text"))


def _records(spark, sf):
    return R.json_records(raw_documents(spark, sf))


@register("scan_json_records")
def q_s1(spark, sf):
    return _records(spark, sf)


FILES = 4


def _landed_files(lines):
    """Folder with one file for each ``file_no`` of lines (file_no, k, pos, line), in the order of k and pos."""
    path = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    lines.repartition("file_no").sortWithinPartitions("file_no", "k", "pos").select("file_no", "line") \
        .write.partitionBy("file_no").text(path)
    return path


def _framed(rows, first, last):
    """Lines of files: ``rows`` (file_no, pos, line) between a first and a last line for each file."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(i, k, 0, t) for k, texts in ((0, first), (2, last)) for i, t in enumerate(texts) if t is not None],
                                 "file_no long, k int, pos long, line string")
    return rows.select("file_no", F.lit(1).alias("k"), "pos", "line").unionByName(ends)


def _by_file(records):
    return records.select(F.regexp_extract("doc_id", r"file_no=(\d+)", 1).cast("long").alias("file_no"), "rec_pos", "record")


@register("scan_json_files")
def q_s1_files(spark, sf):
    """S1 on few large files, each read by byte ranges: a list of objects, an object with a list, a table, and a list
    set out over several lines."""
    file_no = F.col("pos") % FILES
    plain = F.to_json(F.struct("id", "name", "city"))
    wide = F.concat(F.lit('{ "id" : "'), F.col("id"), F.lit('",\n  "name": "'), F.col("name"), F.lit('", "city": "'), F.col("city"), F.lit('" }'))
    line = F.when(file_no == 2, F.to_json(F.array("id", "name", "city"))).when(file_no == 3, wide).otherwise(plain)
    rows = inputs.centres(spark, sf).select(file_no.alias("file_no"), "pos", F.concat(F.lit(","), line).alias("line"))
    first = ['["list"', '{"meta": {"tags": ["a", "b"]}, "data": [{"name": "first"}', '[[["id", "name", "city"]', '[ "list"']
    path = _landed_files(_framed(rows, first, ["]", '], "end": 1}', "]]", "]"]))
    return _by_file(G.json_file_records(spark, path))


@register("scan_csv_files")
def q_s2_files(spark, sf):
    """S2 on few large files, each read by byte ranges; a field holds a line break and quotes."""
    note = F.concat(F.lit('"line one\nsays ""hi"", '), F.col("pos").cast("string"), F.lit('"'))
    rows = inputs.centres(spark, sf).select(
        (F.col("pos") % FILES).alias("file_no"), "pos", F.concat_ws(",", "name", "city", note).alias("line"))
    return _by_file(G.csv_file_records(spark, _landed_files(_framed(rows, ["name,city,note"] * FILES, [None] * FILES))))


@register("scan_csv_records")
def q_s2(spark, sf):
    c = inputs.centres(spark, sf)
    txt = F.concat(F.lit("name,city,country\n"), F.col("name"), F.lit(","), F.col("city"), F.lit(","),
                   F.col("country"), F.lit("\n"))
    return R.csv_text_records(c.select(F.col("pos").alias("doc_id"), txt.alias("text")))


@register("normalize_records")
def q_n1(spark, sf):
    n = N.normalize_records(_records(spark, sf), NORMALIZED_AT)
    return r6(n.select("doc_id", "rec_pos", "id", "name", "address", "city", "state", "country",
                       "postal_code", "phone", "latitude", "longitude"))


@register("map_fields")
def q_n2(spark, sf):
    mapped = N.map_fields(F.col("_values"))
    return N.with_values(_records(spark, sf)).select("doc_id", "rec_pos", *[v.alias(k) for k, v in mapped.items()])


@register("name_fallback")
def q_n3(spark, sf):
    return N.with_values(_records(spark, sf)).select(
        "doc_id", "rec_pos", N.name_fallback(F.col("_values")).alias("fallback_name"))


@register("generate_id")
def q_n4(spark, sf):
    return N.with_values(_records(spark, sf)).select(
        "doc_id", "rec_pos", N.generate_id(F.col("_values"), F.col("record")).alias("gen_id"))


@register("load_dataset_envelope")
def q_s8(spark, sf):
    c = inputs.centres(spark, sf)
    env = F.to_json(F.struct(F.struct(F.lit(K.DATASET_VERSION).alias("version")).alias("metadata"),
                             F.array(F.struct("id", "name", "city", "latitude", "longitude")).alias("centres")))
    docs = c.select(F.col("pos").alias("doc_id"), env.alias("text"))
    return R.dataset_envelope_records(docs)


@register("load_centres")
def q_s7(spark, sf):
    """S7 on in-table JSON arrays of normalised centres: missing keys default."""
    c = inputs.centres(spark, sf)
    arr = F.to_json(F.array(F.struct("id", "name", "city", "country", "latitude", "longitude")))
    parsed = F.from_json(arr, f"array<struct<{N.CENTRE_DDL.replace(' string', ':string').replace(' double', ':double')}>>")
    rows = c.select(F.col("pos").alias("doc_id"), F.posexplode(parsed).alias("rec_pos", "c"))
    out = rows.select("doc_id", "rec_pos", *[F.coalesce(F.col(f"c.{f}"), F.lit("")).alias(f)
                                              for f in K.CENTRE_STRING_FIELDS],
                      F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude"))
    return r6(out)


# X1-X4 -----------------------------------------------------------------------------
def _centres_with_raw(spark, sf):
    c = inputs.centres(spark, sf)
    raw = F.to_json(F.struct(F.col("id").alias("TestCenterCode"), F.col("name").alias("TestCenterName"),
                             F.col("city").alias("City")))
    return c.withColumn("phone", F.lit("")).withColumn("raw_record", raw)


@register("flatten_schema")
def q_x1(spark, sf):
    n = N.normalize_records(_records(spark, sf), NORMALIZED_AT)
    return r6(X.flatten_columns(n.drop("record")))


def _mixed_raw(spark, sf):
    """Centres with raw records of three kinds: which keys there are shows in all rows only."""
    c = inputs.centres(spark, sf)
    plain = F.to_json(F.struct(F.col("id").alias("TestCenterCode"), F.col("city").alias("City")))
    nested = F.to_json(F.struct(F.col("name").alias("TestCenterName"), F.struct(
        F.col("city").alias("city"), F.col("postal_code").alias("zip")).alias("address")))
    raw = F.when(F.col("pos") % 3 == 0, plain).when(F.col("pos") % 3 == 1, nested).otherwise(F.lit("[]"))
    return c.withColumn("raw_record", raw)


@register("infer_schema_map")
def q_x2(spark, sf):
    """X2 over all records: where each field of the user's sample comes from."""
    found = X.plan_schema_map(_mixed_raw(spark, sf), SAMPLE_OUTPUT, all_rows=True)
    return spark.createDataFrame(list(found.items()), "path string, source string")


@register("raw_path_support")
def q_x2_paths(spark, sf):
    return X.path_support(_mixed_raw(spark, sf))


@register("alias_resolve")
def q_x5(spark, sf):
    """X5 on field names of several spellings, one for each document."""
    names = ["lat", "LNG", "Centre_Name", "zip", "Postcode", "address.zip", "location", "telephone", "town ", ""]
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int")).alias("path"))
    return X.alias_resolve(d)


@register("apply_schema")
def q_x4(spark, sf):
    df = _centres_with_raw(spark, sf)
    plan = X.plan_schema_map(df, SAMPLE_OUTPUT)
    return X.flat_record(df, plan)


@register("save_transformed")
def q_k6(spark, sf):
    """K6: the reshaped records as the JSON text that is written (one per row)."""
    df = _centres_with_raw(spark, sf)
    rec = X.apply_schema(df, X.plan_schema_map(df, SAMPLE_OUTPUT))
    return rec.select("pos", F.to_json("record").alias("json"))


# K1 / K2 ---------------------------------------------------------------------------
@register("save_centres")
def q_k1(spark, sf):
    """K1: each normalised centre as the JSON object that is written."""
    n = N.normalize_records(_records(spark, sf), NORMALIZED_AT)
    return n.select("doc_id", "rec_pos", F.to_json(F.struct(
        *K.CENTRE_STRING_FIELDS, "latitude", "longitude", "metadata")).alias("json"))


@register("save_dataset_envelope", """
SELECT CAST(count(*) AS BIGINT) AS total_centres, '1.0.0' AS version FROM centres""", ("centres",))
def q_k2(spark, sf):
    """K2: the envelope's metadata (written as a sidecar; the centres are written
    as partitioned JSON lines rather than one array through one task)."""
    c = inputs.centres(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("total_centres")).withColumn("version", F.lit(K.DATASET_VERSION))


# Provider payloads -------------------------------------------------------
def landed_payloads(spark, sf):
    """One landed response per fixture candidate, in its provider's layout."""
    from pyspark.sql import functions as F
    c = inputs.candidates(spark, sf)
    q = F.concat(F.lit("q"), F.col("pos").cast("string"), F.lit("_"), F.col("query_rank").cast("string"))
    nomi = F.to_json(F.array(F.struct(
        F.concat(F.col("name"), F.lit(", "), F.col("city")).alias("display_name"),
        F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lon"),
        (F.col("confidence") / 2).alias("importance"), F.col("raw_type").alias("type"),
        F.struct(F.lit("12").alias("house_number"), F.lit("Main Road").alias("road"),
                 F.col("city").alias("town"), F.col("country").alias("country")).alias("address"))))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.array(F.col("longitude"), F.col("latitude")).alias("coordinates")).alias("geometry"),
                    F.struct(F.col("name").alias("name"), F.col("city").alias("city"),
                             F.col("country").alias("country"), F.lit("Main Road").alias("street"),
                             F.concat(F.col("name"), F.lit(", "), F.col("city")).alias("formatted"),
                             F.col("confidence").alias("score"),
                             F.struct((F.col("confidence") * 2).alias("confidence")).alias("rank"),
                             F.col("raw_type").alias("category")).alias("properties"))
    geo = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feat).alias("features")))
    el = F.struct(F.col("cand_pos").alias("id"),
                  F.when(F.col("cand_pos") % 2 == 0, F.col("latitude")).alias("lat"),
                  F.when(F.col("cand_pos") % 2 == 0, F.col("longitude")).alias("lon"),
                  F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("center"),
                  F.create_map(F.lit("name"), F.col("name"), F.lit("addr:city"), F.col("city"),
                               F.lit("addr:country"), F.when(F.col("country") == "India", F.lit("in"))
                               .otherwise(F.lit("XX")), F.lit("amenity"), F.lit("school")).alias("tags"))
    ovp = F.to_json(F.struct(F.array(el).alias("elements")))
    payload = (F.when(F.col("provider") == "nominatim", nomi).when(F.col("provider") == "overpass", ovp)
                .otherwise(geo))
    return c.select(q.alias("query"), "provider", payload.alias("payload"), "pos", "cand_pos")


def _parsed(spark, sf, name):
    from pyspark.sql import functions as F
    from ..sources import providers as P
    p = landed_payloads(spark, sf)
    return r6(P.PARSERS[name](p.filter(F.col("provider") == name)).drop("raw"))


@register("parse_nominatim")
def q_s9(spark, sf):
    return _parsed(spark, sf, "nominatim")


@register("parse_photon")
def q_s10(spark, sf):
    return _parsed(spark, sf, "photon")


@register("parse_geoapify")
def q_s11(spark, sf):
    return _parsed(spark, sf, "geoapify")


@register("parse_overpass")
def q_s12(spark, sf):
    return _parsed(spark, sf, "overpass")


# N16 -------------------------------------------------------------------------------
@register("parse_request_log")
def q_n16(spark, sf):
    """Logged fetch commands (built from the pages table) parsed per row."""
    from pyspark.sql import functions as F
    from ..operators.requests import parse_request_log
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages")
    k = F.col("page_id") % 4
    cmd = (F.when(k == 0, F.concat(F.lit("curl '"), F.col("url"), F.lit("' -H 'Accept: text/html' --compressed")))
            .when(k == 1, F.concat(F.lit("curl -X POST '"), F.col("url"), F.lit("' \\\n  -H 'Content-Type: application/json' \\\n  --data '{\"page\": "),
                                   F.col("page_id").cast("string"), F.lit("}'")))
            .when(k == 2, F.concat(F.lit("curl -k \""), F.col("url"), F.lit("\" -b 'session=s"),
                                   F.col("page_id").cast("string"), F.lit("; lang=en' -u 'user:pw'")))
            .otherwise(F.concat(F.lit("curl -H 'Accept: */*' '"), F.col("url"), F.lit("'"))))
    r = parse_request_log(p.select("page_id", cmd.alias("command")))
    return r.select("page_id", "method", "url", F.size("headers").alias("n_headers"), "accept", "content_type",
                    F.size("cookies").alias("n_cookies"), "data", "json_data", F.col("auth.username").alias("user"),
                    "compressed", "insecure", F.size("query_params").alias("n_params"), "error")


# S14 -------------------------------------------------------------------------------
def _ingested(spark, sf, second, full):
    """The dataset after two availableNow runs over landed documents: the previous dataset, then ``second``."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    for seq, rows in ((1, inputs.existing(spark, sf)), (2, second)):
        doc = F.to_json(F.array(F.struct("id", "name", "address", "city", "state", "country", "postal_code", "latitude", "longitude")))
        rows.select(F.lit(seq).cast("long").alias("seq"), F.col("pos").alias("doc_id"), doc.alias("text")) \
            .write.mode("append").option("compression", "gzip").json(f"{root}/landing")
        start_ingest(spark, f"{root}/landing", f"{root}/out", NORMALIZED_AT, full=full).awaitTermination()
    return r6(current_dataset(spark, f"{root}/out").drop("metadata"))


@register("stream_ingest_landed")
def q_s14(spark, sf):
    """Two landed snapshots, the second one a whole new list."""
    return _ingested(spark, sf, inputs.centres(spark, sf), full=True)


@register("stream_ingest_changes")
def q_s14_changes(spark, sf):
    """A landed snapshot, then changes to some of its centres; the others stay."""
    return _ingested(spark, sf, inputs.centres(spark, sf).where("pos % 10 = 0"), full=False)
