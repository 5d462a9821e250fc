"""Landed file classification and decompression."""

import gzip
import io
import zipfile

from pyspark.sql import functions as F

from geoverity.operators.landed import classify_landed_file, decompress_payloads


def _zip(data: bytes) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.json", data)
    return buf.getvalue()


def test_classify(spark):
    rows = [
        (0, b"{}", "application/json"), (1, b"x", "text/csv"), (2, b"x", "text/html"),
        (3, b"x", "application/gzip"), (4, _zip(b"[]"), None), (5, gzip.compress(b"[1]"), None),
        (6, b'  [{"a": 1}]', None), (7, b"<!DOCTYPE html><p>", None), (8, b"a,b\n1,2", None),
        (9, b"hello", None), (10, b"{not json", None),
    ]
    df = spark.createDataFrame(rows, "i long, content binary, ct string")
    got = {r.i: r.f for r in df.select("i", classify_landed_file("content", "ct").alias("f")).collect()}
    assert got == {0: "json", 1: "csv", 2: "html", 3: "zip", 4: "zip", 5: "gzip", 6: "json", 7: "html",
                   8: "csv", 9: "unknown", 10: "unknown"}


def test_decompress(spark):
    rows = [(0, gzip.compress(b"abc"), "gzip"), (1, _zip(b"xyz"), "zip"), (2, b"plain", "json")]
    df = spark.createDataFrame(rows, "i long, payload binary, format string")
    got = {r.i: bytes(r.payload) for r in decompress_payloads(df).collect()}
    assert got == {0: b"abc", 1: b"xyz", 2: b"plain"}


def test_inflated_in_parts(spark):
    """Every member, in bounded parts; a content far larger than a part; archives that can't be read."""
    import io
    import zipfile

    from geoverity.operators.landed import inflated
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/", "")
        z.writestr("a/b.txt", b"b" * 2500)
        z.writestr("empty", b"")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    big = bytes(40_000_000)
    rows = [(0, gzip.compress(b"ab") + gzip.compress(b"c" * 1500) + b"\0\0", "gzip"), (1, held.getvalue(), "zip"), (2, b"x" * 2001, "csv"),
            (3, gzip.compress(b"cut" * 900)[:-12], "gzip"), (4, b"PK no zip", "zip"), (5, None, "zip"), (6, b"", "csv"),
            (7, gzip.compress(big), "gzip"), (8, empty.getvalue(), "zip")]
    df = spark.createDataFrame(rows, "file_id long, payload binary, format string")
    got, sizes = {}, {}
    for r in inflated(df, size=1000).where("file_id != 7").orderBy("file_id", "member", "part").collect():
        got.setdefault((r.file_id, r.member, r.name), []).append(r.error.split(":")[0] if r.error else bytes(r.data))
        assert r.data is None or len(r.data) <= 1000
    assert {k: b"".join(v) for k, v in got.items() if k[0] in (0, 1, 2, 6, 8)} == {
        (0, 0, None): b"ab" + b"c" * 1500, (1, 0, "a/b.txt"): b"b" * 2500, (1, 1, "empty"): b"", (2, 0, None): b"x" * 2001,
        (6, 0, None): b"", (8, 0, None): empty.getvalue()}
    assert got[3, 0, None][-1] == "EOFError" and got[4, 0, None] == ["BadZipFile"] and not any(k[0] == 5 for k in got)
    large = inflated(df.where("file_id = 7")).selectExpr("max(length(data)) AS part", "sum(length(data)) AS total").first()
    assert (large.part, large.total) == (1 << 20, len(big))
    whole = {r.file_id: r.payload for r in decompress_payloads(df.where("file_id != 7")).collect()}
    assert whole[3] is None and whole[4] is None and whole[5] is None and bytes(whole[1]) == b"b" * 2500 and bytes(whole[6]) == b""
