"""WARC archives of pages, and their index merged from sorted runs.

Archives are written by Spark's text writer, one record a value, with the blank lines that end a record as line
separator; the files are gzipped WARC 1.1.  A payload that several pages share is stored once: the page with the
smallest id is a response, the others revisit it.  Reading back parses the files by their Content-Length.  Every
archive gives a run of captures sorted by URL key and time; ranges of that order are dealt to tasks, and each
merges the stretches of all runs in its range with a loser tree, so the captures of all tasks together are in
global order.  A range may end inside a busy URL, since time and record are part of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditloom.functions.session import materialise, scratch_path

LEAST = 100  # bytes of a payload that can be revisited
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("run string, url_key string, captured string, page string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to string, position long, length long")


def _headers(*lines: tuple[str, Column | str]) -> list[Column]:
    """Lines of a header as text columns; a line with a null value is left out."""
    return [F.coalesce(F.concat(F.lit(name + ": "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")), F.lit(""))
            for name, v in lines]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", time_col: str | None = None, records_per_file: int = 20_000) -> None:
    """Write one record per row.  Null html is an empty payload; null ids and URLs leave their headers empty.

    Rows with equal payloads and the smallest id are all responses if that id is repeated; null ids revisit
    others unless no row of the payload has an id.  Without ``time_col`` the date is the id in seconds.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    time = F.col(time_col) if time_col else F.timestamp_seconds(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    rows = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(url_col, "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"), F.octet_length(html).alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"),
        F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz")),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    shared = materialise(rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
        .select("digest", "first"), "warc-shared")
    met = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), *_headers(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", uri("id")),
            ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, uri("first"))),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length.cast("string"))),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("html")))
    met.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the right, then path and query; scheme and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    shown = f":{port}" if port not in (None, 80, 443) else ""
    return f"{labels}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _unpacked(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed parts of a gzip file of one or more members."""
    left = content
    while left:
        member = zlib.decompressobj(31)
        for at in range(0, len(left), step):
            yield member.decompress(left[at:at + step])
            if member.eof:
                left = member.unused_data + left[at + step:]
                break
        else:
            raise ValueError("archive ends inside a gzip member")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, position and length of every record of a gzipped archive; one record in memory at a time."""
    parts, held, passed = _unpacked(content), bytearray(), 0

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends inside a header")
                return
        head = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at {passed}")
        fields = dict(line.split(": ", 1) for line in head[1:] if ": " in line)
        whole = end + 4 + int(fields["Content-Length"])
        while len(held) < whole + 4:
            if not more():
                raise ValueError("archive ends inside a record")
        yield fields, bytes(held[end + 4:whole]), passed, whole + 4
        del held[:whole + 4]
        passed += whole + 4


def _captures(path: str, content: bytes) -> list[tuple]:
    """The captures of an archive, sorted: a run."""
    out = []
    for fields, block, position, length in records(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        kind = fields["WARC-Type"]
        if kind == "response":
            found = hashlib.sha256(payload).hexdigest()
            if found != digest or len(payload) != size:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        page, first = (fields.get(k, "")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        out.append((path, url_key(fields.get("WARC-Target-URI")), fields.get("WARC-Date", ""), page, kind, size,
                    digest, first, position, length))
    return sorted(out, key=lambda r: r[1:4])


def _read(batches):
    names = [f.split()[0] for f in CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            run = _captures(path.as_py(), content.as_py())
            if run:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*run))), schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in CAPTURE.split(", ")])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive below ``path``, each archive a sorted run.  Payloads are checked."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, CAPTURE)


def merged(runs: list[list]) -> list[tuple[int, int]]:
    """Order of the items of sorted lists, as (list, place), by a loser tree; ties go to the earlier list.

    Node 0 holds the winner, every other node the loser of the match played there; after the winner is taken,
    its list's next item plays up the path from its leaf.
    """
    k = len(runs)
    at = [0] * k
    spent = lambda r: at[r] >= len(runs[r])

    def beats(a: int, b: int) -> bool:
        if spent(a) or spent(b):
            return not spent(a) and (spent(b) or a < b) or spent(a) and spent(b) and a < b
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or x == y and a < b

    tree = [0] * max(1, k)
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    out = []
    for _ in range(sum(map(len, runs))):
        out.append((best, at[best]))
        at[best] += 1
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2
    return out


def _merge(batches):
    """Merge the stretches of runs of a range; they come one run after another."""
    table = pa.Table.from_batches(list(batches), _schema())
    if not table.num_rows:
        return
    starts, runs, last = [], [], None
    keys = zip(*(table.column(c).to_pylist() for c in ("run", "url_key", "captured", "page")))
    for i, (run, *key) in enumerate(keys):
        if run != last:
            starts.append(i)
            runs.append([])
            last = run
        runs[-1].append(tuple(key))
    yield from table.take(pa.array([starts[r] + i for r, i in merged(runs)])).to_batches(10_000)


def capture_histories(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time and record, over partitions that are ranges of that order."""
    key = ("url_key", "captured", "page")
    return runs.repartitionByRange(*key).sortWithinPartitions("run", *key).mapInArrow(_merge, CAPTURE)


def archived(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge their index.

    Columns: see ``CAPTURE``; page and refers_to are the ids as text, empty if null.  An empty table has no
    captures.  Other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return capture_histories(materialise(read_runs(pages.sparkSession, path), "warc-runs"))
