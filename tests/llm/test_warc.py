import glob
import gzip
import hashlib
import os

import pytest

from shellgraph.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{i}</p>" * (i * 10)) for i in range(60)]
    rows += [(100, "http://a/1", big), (101, "http://a/2", big), (99, None, big), (101, "http://a/2", big), (None, "http://n\n/é", big), (102, "http://b", "short"), (103, "http://c", "short"), (104, "x", None), (105, None, ""), (106, "y", "漢字" * 500), (107, "z", "漢字" * 500)]
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'q' as range", "1 as record_type")


def test_round_trip(spark, pages, tmp_path):
    root = f"file://{tmp_path}/one"
    listing = warc.write(pages, root, warc.Layout(range_bytes=20_000, roll_bytes=3_000)).collect()
    assert len(listing) > 4 and sorted(os.listdir(tmp_path / "one")) == sorted([f.name for f in listing] + ["manifest.json"])
    got = warc.read(spark, root).collect()
    assert len(got) == pages.count()
    texts = {}
    for r in pages.collect():
        texts.setdefault(r.page_id, []).append(r.html or "")
    for r in got:
        body = texts[r.page_id][0].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.payload == (bytearray(body) if r.record_type == "response" else None)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[100] == kinds[99] == ("revisit", 101) and kinds[101] == ("response", None) and kinds[None] == ("revisit", 101)
    assert kinds[102] == kinds[103] == ("response", None) and kinds[106] == ("revisit", 107)


def test_same_files_however_partitioned(spark, pages, tmp_path):
    names = []
    for i, p in enumerate((pages.coalesce(1), pages.repartition(7))):
        warc.write(p, f"file://{tmp_path}/{i}", warc.Layout(range_bytes=20_000, roll_bytes=3_000))
        names.append({os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{i}/*")})
    assert names[0] == names[1]


def test_uncommitted_is_not_read(spark, pages, tmp_path):
    root = f"file://{tmp_path}/w"
    warc.write(pages, root)
    with gzip.open(tmp_path / "w" / "range-999999-0000.warc.gz", "wb") as f:
        f.write(b"left behind")
    assert warc.read(spark, root).count() == pages.count()
    name = next(f.name for f in warc.manifest(spark, root).collect())
    with gzip.open(tmp_path / "w" / name, "rb") as f:
        data = f.read()
    with gzip.open(tmp_path / "w" / name, "wb") as f:
        f.write(data.replace(b"xxxx", b"xxyx", 1))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, root).collect()


def test_empty(spark, pages, tmp_path):
    root = f"file://{tmp_path}/none"
    assert warc.write(pages.where("false"), root).collect() == [] and warc.read(spark, root).collect() == []
