"""WARC archives: one record per page, equal payloads written once, and a reader that follows the chain of records.

Archives are read in splits, by many tasks. The line that begins a record may stand inside a payload too, so a task only
knows candidates: where such a line is, and where its Content-Length says the next record begins. From the start of a file
these successors are followed by pointer jumping; candidates that the chain doesn't reach are payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import splits
from .common import Scratch, common_rows, materialise

MAGIC = "WARC/1.0\r\n"
#: A record's first line stands behind the end of a line. The line feed behind it is left to the piece, as the separator
#: must not overlap with itself.
SEPARATOR = "\nWARC/1.0\r"
END = "\r\n\r\n"
#: Payloads of fewer bytes are written in full, however often they occur.
MIN_SHARED = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Fixed value: the date of every record, so that archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_shared: int = MIN_SHARED) -> None:
    """A record for each page under ``path``, in as many files as there are tasks.

    Of pages with equal payloads of ``min_shared`` bytes or more, that with the largest id is a response, the others are
    revisits that refer to it, with headers only. Null payloads are empty. A page with a null id is a response, and so is
    each of several pages that share the largest id of a payload. White space and control characters of an URL are
    escaped. Extra columns are ignored; without pages there are no records.
    """
    payload = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    with Scratch(pages.sparkSession, "payloads") as work:
        shared = rows.where((F.col("size") >= min_shared) & F.col("id").isNotNull())
        groups = work.table(shared.groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "groups")
        rows = common_rows(rows, groups, "key", pages.count())
        again = F.coalesce(F.col("keeper") > F.col("id"), F.lit(False))
        url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
        url = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
        http = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(END))
        block = F.when(again, http).otherwise(F.concat(http, "payload"))
        record = F.concat(
            F.lit(MAGIC),
            _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            _line("WARC-Record-ID", _urn(F.col("id"))),
            _line("WARC-Date", F.lit(DATE)),
            _line("WARC-Target-URI", url),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
            F.when(again, F.concat(_line("WARC-Refers-To", _urn(F.col("keeper"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        )
        rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def header(head: str, name: str) -> Column:
    """The value of a header field, in any case; null without it."""
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.when(F.col(head).rlike(f"(?im)^{name}:"), found)


def _candidates(pieces: DataFrame) -> DataFrame:
    """(path, block, at, offset, next): where a record may begin, and where its length puts the next one; null if it has no
    header with a length, or ends behind the file."""
    head, value = F.substring_index("value", END, 1), F.col("value")
    narrow = pieces.select(
        "path", "file_size", "block", "at", F.octet_length(value).cast("long").alias("size"), head.alias("head"), F.octet_length(head).cast("long").alias("head_size"),
        value.startswith(MAGIC).alias("begins"), value.startswith("\n").alias("goes_on"),
    )
    narrow = narrow.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?im)^content-length:[ \\t]*([0-9]+)[ \\t]*$', 1) as bigint)"))
    rows = splits.sum_before(narrow.drop("head"), F.col("size") + len(SEPARATOR), "start")
    first = F.col("start") == 0  # all others come behind a separator
    offset = F.when(first, F.lit(0)).otherwise(F.col("start") - len(SEPARATOR) + 1)
    fine = (F.col("head_size") < F.col("size")) & F.col("length").isNotNull() & F.when(first, F.col("begins")).otherwise(F.col("goes_on"))
    after = F.col("start") + F.col("head_size") + len(END) + F.col("length") + len(END)
    return rows.select("path", "block", "at", offset.alias("offset"), F.when(fine & (after <= F.col("file_size")), after).alias("next"))


def _reached(candidates: DataFrame, work: Scratch) -> DataFrame:
    """``candidates`` that the chain from the start of their file reaches, with ``hit``.

    Candidates of a block whose successor is the next one make a run, which ends at every candidate that is a successor from
    elsewhere. Runs have one entry and one exit, so pointers jump between runs: in each round every run's pointer is
    replaced by the pointer of the run that it points to, and the runs reached so far reach as many more. The rounds
    grow with the logarithm of the runs in a file.
    """
    window = splits.block_window()
    linked = candidates.withColumn("regular", F.coalesce(F.col("next") == F.lead("offset").over(window), F.lit(False)))
    linked = work.table(linked, "links")
    entries = linked.where("next is not null and not regular").select("path", F.col("next").alias("offset")).distinct().withColumn("entry", F.lit(True))
    met = linked.join(entries, ["path", "offset"], "left")
    opens = F.col("entry").isNotNull() | ~F.coalesce(F.lag("regular").over(window), F.lit(False))
    runs = met.withColumn("run", F.when(opens, F.col("offset")))
    runs = runs.withColumn("run", F.last("run", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    runs = work.table(runs.select("path", "block", "at", "offset", "next", "run"), "runs")
    jump = work.table(runs.groupBy("path", "run").agg(F.max_by(F.struct("next"), "offset")["next"].alias("to")).where("to is not null"), "jump")
    hit = work.table(runs.where("run = 0").select("path", "run").distinct(), "hit")
    while not jump.isEmpty():
        more = hit.join(jump, ["path", "run"]).select("path", F.col("to").alias("run"))
        hit = work.table(hit.union(more).distinct(), "hit")
        jump = work.table(jump.join(jump.select("path", F.col("run").alias("to"), F.col("to").alias("far")), ["path", "to"]).select("path", "run", F.col("far").alias("to")), "jump")
    return runs.join(hit.withColumn("hit", F.lit(True)), ["path", "run"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & F.col("next").isNotNull()).drop("run")


def records(spark: SparkSession, path: str, work: Scratch) -> DataFrame:
    """(head, block) of each record of the archives under ``path``: its header lines, and its content as bytes.

    Lines inside a content that look like the start of a record stay content. A file that begins otherwise has no records;
    a record without a length, or longer than its file, and what follows it in the file are left out. An empty file or
    folder has no records. The tables of this call belong to ``work``.
    """
    pieces = work.table(splits.pieces(spark, path, SEPARATOR), "pieces", codec="zstd")
    known = work.table(_reached(_candidates(pieces), work), "known")
    # Most records are one piece. Others: a file's first, and contents with separators, put together from their pieces.
    owned = splits.last_before(known, F.when(F.col("hit"), F.col("offset")), "owner").where("owner is not null")
    parted = owned.where("not hit").select("path", "owner").distinct().unionByName(owned.where("offset = 0").select("path", "owner"))
    special = work.table(owned.join(parted.distinct(), ["path", "owner"], "left_semi").select("at", "offset", "path", "owner"), "special")
    unknown = known.join(owned.select("at"), "at", "left_anti").select("at")
    skipped = work.table(special.select("at").union(unknown), "skipped")
    whole = pieces.join(skipped, "at", "left_anti").select(F.concat(F.lit(SEPARATOR[1:]), "value").alias("value"))
    parts = pieces.select("at", "value").join(special, "at").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), SEPARATOR)
    joined = parts.select(F.when(F.col("owner") == 0, joined).otherwise(F.concat(F.lit(SEPARATOR[1:]), joined)).alias("value"))
    found = whole.unionByName(joined).withColumn("head", F.substring_index("value", END, 1))
    length = header("head", "content-length").cast("int")
    return found.select("head", F.substr(F.col("value").cast("binary"), F.octet_length("head") + len(END) + 1, length).alias("block"))


def read_pages(spark: SparkSession, path: str, work: Scratch) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, intact) of each record of ``write_archives``.

    Size and digest are those of the full payload: of a response its own, of a revisit those of the response that it
    refers to. ``intact`` says that they agree with the digest in the record's header, which tells responses of one id apart.
    """
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    payload = F.substr("block", F.octet_length(http) + len(END) + 1)
    page = lambda name: F.nullif(F.regexp_extract(header("head", name), "urn:page:([^>]*)", 1), F.lit("")).cast("long")
    read = records(spark, path, work).select(
        page("warc-record-id").alias("page_id"), header("head", "warc-type").alias("record_type"), page("warc-refers-to").alias("refers_to"),
        F.regexp_extract(header("head", "warc-payload-digest"), "sha1:(.*)", 1).alias("claimed"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    read = work.table(read, "read")
    key = lambda c: F.concat_ws(":", c, "claimed")
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "claimed", key("refers_to").alias("key"))
    full = read.where("record_type = 'response' and page_id is not null").select(key("page_id").alias("key"), "digest", "bytes").dropDuplicates(["key"])
    wanted = work.table(again.groupBy("key").agg(F.count("*").alias("n")).join(full, "key"), "wanted")
    resolved = common_rows(again, wanted, "key", again.count()).drop("key", "n")
    all_ = read.where("record_type = 'response'").unionByName(resolved)
    return all_.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("digest") == F.col("claimed")).alias("intact"))


def archive_pages(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """The pages written to archives in the shared folder and read back; the archives go when the result is written."""
    spark = pages.sparkSession
    with Scratch(spark, "archives") as work:
        path = f"{work.path}/warc"
        write_archives(pages, path, min_shared=min_shared)
        return materialise(read_pages(spark, path, work), "warc-pages")
