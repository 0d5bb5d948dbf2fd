"""Archives written, read back in small splits, and attacked from inside payloads."""

import hashlib

import pytest
from pyspark.sql import functions as F

from steploom.llm import warc
from steploom.llm.common import Scratch, conf

from .test_operators import SF

SMALL = {"spark.sql.files.maxPartitionBytes": "3001", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
PAGES = "page_id long, url string, html string"


def expected(rows, min_shared=1000):
    keeper = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= min_shared:
            keeper[html] = max(keeper.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        k = keeper.get(html)
        again = i is not None and k is not None and k > i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", k if again else None))
    return sorted(out, key=str)


def back(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def fake(length, body, lead="\r\n\r\n"):
    return f"{lead}WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {length}\r\n\r\n{body}"


def attacks():
    long = "x" * 1500
    rows = [
        (1, "u", fake(4, "fake")), (2, "u", fake(4, "fake\r\n\r\n")), (3, "u", "a" + fake(3, "abc\r\n\r\n", "\n") + fake(0, "") + "tail"),
        (4, "u", "\nWARC/1.0\r\n"), (5, "u", "WARC/1.0\r\n" * 40), (6, "u", "\nWARC/1.0\r\n" * 200), (7, "u", "\r\n\r\n\r\n\r\n"), (8, None, None), (9, "u", ""),
        (10, "a\r\nContent-Length: 1\r\n\r\nb", "é日本" * 500), (11, "x/WARC/1.0\r\n", long), (12, "u", long), (13, "u", long), (None, "u", long), (14, "u", "y" * 999), (15, "u", "y" * 999),
        (16, "u", fake(10**9, "beyond")), (17, "u", fake("12x", "")), (18, "u", "q" * 5000 + fake(2, "ab\r\n\r\n") + "r" * 5000), (19, "u", "\n"), (20, "u", "WARC/1.0"),
    ]
    # Lengths that lead from a false record to the true start of the next one, whatever its distance.
    rows += [(100 + k, "u", "z" * 300 + fake(k, "w" * 40)) for k in range(30, 60)]
    return rows


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("small", [True, False])
def test_payloads_that_look_like_records(spark, files, small):
    rows = attacks()
    df = spark.createDataFrame(rows, PAGES).withColumn("head", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("at", F.lit(2)).repartition(files)
    with conf(spark, SMALL if small else {}):
        got = warc.archive_pages(df)
        assert back(got) == expected(rows)
        assert got.where("not intact").count() == 0


def test_records_give_the_bytes_back(spark):
    rows = attacks()
    with Scratch(spark, "t") as work, conf(spark, SMALL):
        warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(2), f"{work.path}/a", min_shared=10**9)
        got = warc.records(spark, f"{work.path}/a", work).collect()
    bodies = sorted(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in got)
    assert bodies == sorted((t or "").encode() for _, _, t in rows)


def test_broken_archives(spark, tmp_path):
    """What follows a record that isn't whole is left out; files that aren't archives have no records."""
    one = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    files = {"good": one * 5, "cut": one * 2 + one[:-5], "gap": one + b"?" + one, "none": b"hello\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "empty": b"", "case": one.replace(b"Content-L", b"content-l")}
    counts = {}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.warc").write_bytes(data)
        with Scratch(spark, "t") as work:
            counts[name] = warc.records(spark, str(tmp_path / name), work).count()
    assert counts == {"good": 5, "cut": 2, "gap": 1, "none": 0, "empty": 0, "case": 1}


def test_repeated_ids_hot_payloads_and_empty_tables(spark):
    rows = [(k, "u", "h" * 2000) for k in range(300)] + [(299, "u", "h" * 2000), (5, "u", "other" * 300), (5, "u", "short")]
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    assert back(warc.archive_pages(df)) == expected(rows)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_payload_of_megabytes(spark):
    rows = [(1, "u", "lorem ipsum \r\n\r\n" * 600_000 + fake(5, "false")), (2, "u", "lorem ipsum \r\n\r\n" * 600_000 + fake(5, "false")), (3, "u", "s")]
    with conf(spark, {"spark.sql.files.maxPartitionBytes": "1m"}):
        assert back(warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(2))) == expected(rows)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    with conf(spark, {"spark.sql.files.maxPartitionBytes": "20000"}):
        assert back(warc.archive_pages(pages)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
