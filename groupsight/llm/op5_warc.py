"""WARC archives and their capture index by external merging.

Writing: equal payloads are found by digest; of each group the capture with the largest id is a
response record, the others are revisit records that refer to it. Every record is a gzip member of its own, so
an index offset can be sought. Spark's text writer makes the files, so they go to any store Spark writes to: a
member ends in the top byte of its size, which is 0, and the line separator is that byte (a record of 16 MB or
more is followed by an empty member, which ends in 0).

Reading: each archive is parsed member by member and by the records' own lengths, response payloads are digested
anew and compared with their headers, and the archive's captures are sorted by URL key and time:
one local run per archive. Splitters over all runs cut the key space into ranges of about `RANGE_ROWS` captures; in
each range the runs' slices are merged by a loser tree. The ranges in order are the global capture
history; ranges split within a URL too, so one URL with a third of all captures is no single task's.

Edge cases: a null payload is empty; empty payloads are equal to each other; a null URL has the key
"-"; line ends in URLs are percent-encoded; null ids are kept, come before all others and are never
preferred as response; rows repeated with the same id and payload are responses each; captures that
tie in URL and time go by id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import prepare, sized
from groupsight.sources.store import cut, shared_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
FILE_BYTES = 16_000_000
#: Uncompressed bytes of an archive at most, but for single records that are larger.
MOST_BYTES = 256_000_000
RANGE_ROWS = 400_000
_ID = "urn:capture:"
RUN = "run string, url_key string, ts long, id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, seq long"


def base32_of_hex(h: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1."""
    out = []
    for g in range(8):
        n = F.conv(h.substr(5 * g + 1, 5), 16, 10).cast("int")
        out += [F.lit(BASE32).substr(F.shiftright(n, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, ts_col: str | None) -> DataFrame:
    """(value): one WARC record text per page."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    # without a capture time: one second apart, by id
    ts = F.col(ts_col).cast("long") if ts_col else 1_704_067_200 + F.pmod(F.coalesce(id_, F.lit(0)), F.lit(1_000_000_000))
    rows = pages.select(id_.alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"), ts.alias("ts"))
    light = pages.select(id_.alias("id"), F.sha1(payload).alias("sha"))
    shared = light.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(sized(shared, "shared_payloads"), "sha", "left")
    revisit = F.coalesce(F.coalesce(F.col("id"), F.lit(-(2**63)).cast("long")) < F.col("keep"), F.lit(False))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(EOL + EOL)
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat_ws(
        EOL, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("keep")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(EOL + EOL), block, F.lit(EOL + EOL)).alias("value"))


_EMPTY = gzip.compress(b"", mtime=0)


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends in a zero byte."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + _EMPTY


def members(content: bytes, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the gzip members of an archive."""
    at = 0
    while at < len(content):
        start, stream, parts = at, zlib.decompressobj(31), []
        while not stream.eof:
            piece = content[at : at + step]
            if not piece:
                raise ValueError(f"the member at byte {start} does not end")
            parts.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        if record := b"".join(parts):
            yield start, record


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, file_bytes: int = FILE_BYTES, suffix: bool = False,
) -> None:
    """Archives of about file_bytes each under path; see MOST_BYTES. They keep the names that Spark's writer gives them; with suffix they are renamed to *.warc.gz by the driver, a call per file."""
    spark = pages.sparkSession
    prepare(spark)
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) + 700
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    per_file = max(1, min(int(file_bytes / (mean or 1)), int(MOST_BYTES / (most or 1))))

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([member(x)[:-1] for x in s])

    rows = records(pages, id_col, url_col, payload_col, ts_col).select(packed(F.col("value").cast("binary")).cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    if not suffix:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(folder):
        if (name := f.getPath().getName()).endswith(".txt"):
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def url_key(url: str | None) -> str:
    """Sort-friendly key: host parts reversed, scheme, www, default ports and fragment left out."""
    if not url:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    host, port, rest = m.groups()
    host = re.sub(r"^www\d*\.", "", host.lower())
    port = "" if port in (None, "80", "443") else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (rest or "/")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(headers["Content-Length"])
    if record[stop:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, record[end + 4 : stop]


def _id_of(text: str) -> int | None:
    x = text.removeprefix(f"<{_ID}").removesuffix(">")
    return None if x == "null" else int(x)


def local_run(path: str, content: bytes) -> list[tuple]:
    """The archive's captures as rows of RUN, sorted."""
    rows = []
    for at, record in members(content):
        h, block = parse(record)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != size:
                raise ValueError(f"payload at byte {at} of {path} does not match its digest")
        date = pd.Timestamp(h["WARC-Date"])
        refers = _id_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
        rows.append((path, url_key(h.get("WARC-Target-URI")), int(date.timestamp()), _id_of(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], refers, at))
    rows.sort(key=lambda r: (r[1].encode("utf-8"), r[2], r[3] is not None, r[3] or 0, r[8]))
    return [(*r, k) for k, r in enumerate(rows)]


def read_runs(spark, path: str) -> DataFrame:
    """One sorted run of captures per archive under path."""
    prepare(spark)
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                out = pd.DataFrame(local_run(p.rsplit("/", 1)[-1], content), columns=names, dtype=object)  # a null would make floats of whole numbers
                yield out.astype({"id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc.gz,txt}").load(path).select("path", "content")
    return files.mapInPandas(run, RUN)


def loser_tree_merge(runs: list[list]) -> Iterator:
    """Items of sorted runs in order; of equal items, the earlier run's first."""
    k = len(runs)
    if k <= 1:
        yield from (runs[0] if runs else ())
        return
    heads, at = [r[0] if r else None for r in runs], [0] * k

    def beats(i: int, j: int) -> bool:
        if heads[i] is None or heads[j] is None:
            return heads[i] is not None or (heads[j] is None and i < j)
        return (heads[i], i) < (heads[j], j)

    # tree[1..k-1] hold losers, leaf i is node k + i; the winner of all stands outside
    tree, winners = [0] * k, [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1]
    while heads[top] is not None:
        yield heads[top]
        at[top] += 1
        heads[top] = runs[top][at[top]] if at[top] < len(runs[top]) else None
        node = (k + top) // 2
        while node:
            if beats(tree[node], top):
                top, tree[node] = tree[node], top
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """RUN's columns with position, the capture's place in the global order, and capture_no, its place among its URL's."""
    runs = cut(runs, "runs")
    order = ["url_key", "ts", "id", "run", "seq"]
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        if rows.empty:
            return
        known = [x is not None for x in rows.id]
        ids = [int(x) if k else 0 for x, k in zip(rows.id, known, strict=True)]
        keys = list(zip(rows.url_key.str.encode("utf-8"), rows.ts, known, ids, range(len(rows)), strict=True))
        starts = [0, *(rows.index[rows.run.ne(rows.run.shift())][1:]), len(rows)]
        slices = [keys[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        out = rows.iloc[[x[-1] for x in loser_tree_merge(slices)]].reset_index(drop=True)
        out["pos"] = range(len(out))
        yield out

    # within a range, rows stand run by run, each run in its own order; ids travel as text, as pandas would make floats of them beside a null
    ranged = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", "seq").withColumn("part", F.spark_partition_id())
    as_text = ranged.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    schema = RUN.replace(" id long", " id string").replace("refers_to long", "refers_to string") + ", part int, pos long"
    merged = as_text.mapInPandas(merge, schema).withColumns({c: F.col(c).cast("long") for c in ("id", "refers_to")})
    merged = cut(merged, "merged")
    totals, first, at = merged.groupBy("part").count().orderBy("part").collect(), [], 0  # a row per range
    for r in totals:
        first.append((r.part, at))
        at += r["count"]
    starts = spark.createDataFrame(first or [(0, 0)], "part int, first long")
    placed = merged.join(F.broadcast(starts), "part").withColumn("position", F.col("first") + F.col("pos")).drop("part", "first", "pos")
    urls = sized(placed.groupBy("url_key").agg(F.min("position").alias("url_first")), "url_starts")
    return placed.join(urls, "url_key").withColumn("capture_no", F.col("position") - F.col("url_first") + 1).drop("url_first")


def capture_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None) -> DataFrame:
    """Archives of all pages, written and read back, as one ordered history."""
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    write_archives(pages, path, id_col, url_col, payload_col, ts_col)
    return merge_runs(read_runs(spark, path))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    out = capture_history(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position", "capture_no")
