import base64
import gzip
import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymill.llm import warc

PAGES = "page_id long, url string, html string"


def rows():
    out = [(i, f"https://h.example/{i % 7}/é page", f"<p>{i}</p>" * (i % 40)) for i in range(200)]
    out += [(1000 + i, None if i % 3 == 0 else f"https://h.example/{i}", "<html>one and the same\r\n\r\n日本</html>") for i in range(90)]
    return out + [(3000, "u", None), (3001, None, ""), (3002, "u", "x" * 300_000), (None, "nowhere", "<p>1</p>")]


def brute(pages, least):
    """Rows as the archive must hold them, for distinct page ids."""
    payload = lambda html: (html or "").encode()
    last = {}
    for page, _, html in pages:
        if len(payload(html)) >= least:
            last[payload(html)] = max(last.get(payload(html), (False, 0)), (page is not None, page or 0))
    out = []
    for page, _, html in pages:
        data = payload(html)
        first = last.get(data, (page is not None, page or 0))
        mine = first == (page is not None, page or 0)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if mine else "revisit", None if mine else first[1]))
    return sorted(out, key=str)


def summary(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def contents(place):
    return {n: open(f"{place}/{n}", "rb").read() for n in sorted(os.listdir(place)) if n.endswith(".warc.gz")}


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_pages_come_back_as_they_were(spark, tmp_path, least):
    place = f"{tmp_path}/a"
    listed = warc.write_warc(spark.createDataFrame(rows(), PAGES).repartition(5), place, least, shard_bytes=20_000, roll_bytes=2_000)
    back = warc.read_warc(spark, place)
    assert summary(back) == brute(rows(), least)
    texts = {r.page_id: r.payload.decode() for r in back.where("record_type = 'response'").collect()}
    assert all((dict((p, h) for p, _, h in rows())[page] or "") == text for page, text in texts.items())
    urls = {p: u for p, u, _ in rows()}
    assert all(urls[r.page_id] == r.url for r in back.collect())
    assert listed.agg(F.sum("records")).first()[0] == len(rows()) and listed.select("shard").distinct().count() > 5
    assert listed.where("number > 0").count() > 0


def test_revisits_name_a_record_that_is_there(spark, tmp_path):
    place = f"{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows(), PAGES), place, shard_bytes=20_000)
    ids = [r.record_id for r in warc.read_warc(spark, place).select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(rows())
    named = [line.split(b": ")[1].decode() for data in contents(place).values() for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"WARC-Refers-To: ")]
    assert named and set(named) <= set(ids)


def test_files_are_the_same_for_any_partitioning_and_listed_by_digest(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES)
    listed = warc.write_warc(df.repartition(1), f"{tmp_path}/a", shard_bytes=20_000, roll_bytes=2_000)
    warc.write_warc(df.repartition(9), f"{tmp_path}/b", shard_bytes=20_000, roll_bytes=2_000)
    files = contents(f"{tmp_path}/a")
    assert files == contents(f"{tmp_path}/b")
    assert {r.name: (r.bytes, r.sha256) for r in listed.collect()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
    order = [r.page_id for r in warc.read_warc(spark, f"{tmp_path}/a").orderBy("file", "offset").collect()]
    assert order == sorted(order, key=lambda p: (p is not None, p or 0))


def test_damage_and_unfinished_archives_are_errors(spark, tmp_path):
    place = f"{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows(), PAGES), place)
    name, data = next(iter(contents(place).items()))
    with open(f"{place}/{name}", "wb") as f:
        f.write(data[: len(data) - 40])
    with pytest.raises(PySparkException):
        warc.read_warc(spark, place).count()
    with pytest.raises(PySparkException):
        warc.read_warc(spark, f"{tmp_path}/nothing")


def test_only_listed_files_are_read_and_renaming_twice_is_harmless(spark, tmp_path):
    place = f"{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows()[:20], PAGES), place)
    listed = warc.manifest(spark, place).withColumn("temporary", F.lit("_temporary/gone"))
    again = listed.select(*[c.split()[0] for c in warc.FILES.split(", ")]).mapInArrow(warc._committed(place), warc.FILES)
    assert again.count() == listed.count()
    with open(f"{place}/part-99999999-00000.warc.gz", "wb") as f:
        f.write(b"left by an attempt that never finished")
    assert warc.read_warc(spark, place).count() == 20


def test_repeated_rows_and_ids_and_an_empty_table(spark, tmp_path):
    same = [(1, "u", "<p>a</p>")] * 3 + [(2, "u", "<p>b</p>"), (2, "v", "<p>b</p>"), (2, "v", "<p>c</p>")]
    df = spark.createDataFrame(same, PAGES).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).withColumn("shard", F.lit(0))
    got = summary(warc.archived(df))
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (2, "response", None), (2, "response", None), (2, "revisit", 2)]
    assert summary(warc.archived(df, 100)) == sorted(((r[0], r[1], r[2], "response", None) for r in got), key=str)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0
