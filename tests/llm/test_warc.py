"""WARC archives: records read back, the files as plain gzip members, and lookups against a scan of all keys."""

import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import warc

SCHEMA = "page_id long, url string, html string, file string, offset int, digest string, key string"
BIG, SAME = "<p>" + "x" * 300_000, "<html>" + "same " * 40


def pages(spark):
    rng = random.Random(3)
    rows = [(k, f"http://h{rng.randint(0, 3)}.example.com/{rng.randint(0, 40)}", rng.choice([SAME, "short", f"<p>é{k}" * 30]), "f", 1, "d", "k") for k in range(200)]
    extra = [(500, None, None), (501, "", ""), (None, "http://h1.example.com/1", SAME), (None, "no host", "only here " * 20), (502, "https://User@WWW.B.Org:8080/a b?q=1\n#frag", BIG), (503, "//c.org", "<p>字🙂" * 40)]
    extra += [(7, rows[7][1], rows[7][2]), (9, "http://other.example.com/", rows[9][2]), (-5, "http://z.example.com/ü", SAME)]
    return spark.createDataFrame([*rows, *[(*x, "f", 1, "d", "k") for x in extra]], SCHEMA).repartition(4)


def wanted(rows):
    """By walking over all rows."""
    out, least = [], {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= 100 and r.page_id is not None:
            least[data] = min(least.get(data, r.page_id), r.page_id)
    for r in rows:
        data = (r.html or "").encode()
        first = least.get(data)
        again = first is not None and r.page_id != first
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.fixture(scope="module", params=[(warc.BLOCK, warc.FILE_BYTES), (3, 4000)])
def archive(spark, tmp_path_factory, request):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    df = pages(spark).cache()
    warc.write(df, path, block=request.param[0], file_bytes=request.param[1])
    return df, path


def test_all_records(spark, archive):
    df, path = archive
    keys = df.select(warc.url_key(F.col("url")).alias("key"))
    read = warc.records(warc.lookup(spark, path, keys), path)
    assert found(read) == wanted(df.collect())
    texts = {(r.page_id, r.html or "") for r in df.collect()}
    assert all((r.page_id, r.payload.decode()) in texts for r in read.collect() if r.payload is not None)


def test_lookup_finds_just_the_keys_captures(spark, archive):
    df, path = archive
    keyed = [(r.k, r.page_id) for r in df.select(warc.url_key(F.col("url")).alias("k"), "page_id").collect()]
    asked = ["", ")no host", "com,example,h1)/1", "com,example,h2)/7", "absent", "zzz", "org,c)"]
    rows = warc.lookup(spark, path, spark.createDataFrame([(x,) for x in [*asked, "com,example,h1)/1", None]], "key string")).collect()
    assert sorted([(r.key, r.page_id) for r in rows], key=str) == sorted([x for x in keyed if x[0] in asked], key=str)


def test_files_are_plain_warc(archive, spark):
    df, path = archive
    folder = path.removeprefix("file://")
    import glob

    kinds = []
    for name in glob.glob(f"{folder}/archive/*.warc.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1])
            data = rest[size + 4 :]
    rows = df.collect()
    assert kinds.count(b"revisit") == sum(x[3] == "revisit" for x in wanted(rows)) and kinds.count(b"response") + kinds.count(b"revisit") == len(rows)


def test_keys(spark):
    cases = {
        "http://www.B.org/X?y#z": "org,b,www)/X?y", "https://u:p@a.co.uk:8080": "uk,co,a:8080)", "//c.org/": "org,c)/", "mailto:x@y": ")mailto:x@y", "": ")", None: "",
        "http://exa mple.org/a b": "org,exa mple)/a b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", warc.url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == cases


def test_damaged_record_is_refused():
    member = warc.record(1, "http://a.b/", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), "2024-01-01T00:00:00Z", None)
    assert warc.parsed(member)["payload"] == b"x" * 200
    wrong = warc.record(1, "http://a.b/", b"x" * 200, hashlib.sha256(b"y").hexdigest(), "2024-01-01T00:00:00Z", None)
    with pytest.raises(ValueError):
        warc.parsed(wrong)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    warc.write(spark.createDataFrame([], SCHEMA), path)
    rows = warc.lookup(spark, path, spark.createDataFrame([("a",)], "key string"))
    assert warc.records(rows, path).count() == 0
