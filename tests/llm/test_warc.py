"""Archives: members, index, revisits, hostile payloads."""

import gzip
import uuid

from pyspark.sql import functions as F

from corvane.llm import warc
from corvane.llm.common import shared_dir


def test_write_normalise_read(spark, tmp_path):
    pages = [(i, f"http://a/{i}", t, "x") for i, t in enumerate(["one", "two", "one", "", None, "WARC/1.1\r\n\r\nx", "a\r\n\r\n", "é😀" * 5000, "one"])]
    pages += [(3, "http://a/3", "two", "x"), (None, None, "one", "x"), (20, "a\r\nb", "z" * 3_000_000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha1 string").repartition(3)
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    index = warc.normalise(spark, warc.write_monolithic(warc.records(df), f"{folder}/in"), f"{folder}/out")
    assert index.count() == len(pages)
    assert index.exceptAll(warc.read_index(spark, f"{folder}/out")).isEmpty()
    rows = warc.read_archives(index).collect()
    payload = lambda r: next((p[2] or "") for p in pages if p[0] == r["page_id"] and len((p[2] or "").encode()) == r["payload_bytes"])
    for r in rows:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == payload(r) and r["refers_to"] is None
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["refers_to"]) for r in rows if r["record_type"] == "revisit") == [(-1, 0), (2, 0), (3, 1), (4, 3), (8, 0)]
    # every member stands alone at its offset
    r = index.first()
    with open(r["archive"].removeprefix("file:").replace("//", "/"), "rb") as f:
        f.seek(r["offset"])
        assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\n")


def test_records_have_what_the_standard_asks_for(spark):
    df = spark.createDataFrame([(1, "http://a/ b", "é"), (2, None, "é"), (3, "http://c", None)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["record"] for r in warc.records(df, 1, "2024-05-06T07:08:09Z").collect()}
    for page, kind, target, payload in ((1, "response", "http://a/b", "é"), (2, "revisit", "urn:page:2", None), (3, "response", "http://c", "")):
        head, _, block = texts[page].partition("\r\n\r\n")
        first, *lines = head.split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert first == "WARC/1.1" and fields["WARC-Type"] == kind and fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert fields["WARC-Target-URI"] == target and fields["Content-Type"] == "application/http; msgtype=response"
        assert int(fields["Content-Length"]) == len(block.encode())
        if payload is not None:
            http, _, body = block.partition("\r\n\r\n")
            assert http.startswith("HTTP/1.1 200 OK\r\n") and body == payload and f"Content-Length: {len(payload.encode())}" in http
    assert "WARC-Refers-To: <urn:page:1>" in texts[2]


def test_a_removed_folder_is_gone(spark):
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    warc.write_monolithic(warc.records(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")), folder)
    warc.remove(folder)
    system, path = warc.file_system(folder)
    assert system.get_file_info(path).type.name == "NotFound"


def test_smaller_payloads_are_responses_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    kinds = warc.records(df, 3).select("page_id", F.regexp_extract("record", "WARC-Type: (\\w+)", 1).alias("t")).collect()
    assert {r["page_id"]: r["t"] for r in kinds} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    monolithic = warc.write_monolithic(warc.records(df.limit(0)), f"{folder}/in")
    assert warc.read_archives(warc.normalise(spark, monolithic, f"{folder}/out")).count() == 0
