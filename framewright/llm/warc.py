"""WARC archives, and their index by an external merge of sorted runs.

Every record is a gzip member of its own, so that the offset and length in the
index are enough to fetch it.  Archives are bounded by bytes and records, and are
written by Spark's text sink, whose values are the members and whose line
separator is an empty member: commits, retries and any file system work as for
other tables.  Each archive's captures form a run sorted by URL key and time;
runs are dealt out by ranges of (key, time, page), and each range merges the k
runs that reach it with a loser tree, which gives the histories of all captures
in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.store import new_path, small_batches, stored
from framewright.llm.words import released

#: Compressed bytes of an archive, but for its last record, and its records at most; index rows of a range about; payloads with several captures that are sent to all executors at most (about 100 bytes each).
ARCHIVE_BYTES, RECORDS, RANGE_ROWS, MOST_BROADCAST = 64 << 20, 50_000, 200_000, 500_000
END = "\r\n\r\n"
#: A gzip member without content, which stands between records.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_INDEX = "page_id long, urlkey string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hexadecimal digits: each 5 of them are 4 letters."""
    value = lambda i: F.conv(F.substr(hexadecimal, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
    digit = lambda i: F.floor(value(i) / F.element_at(F.lit([32768, 1024, 32, 1]), (i % 4 + 1).cast("int"))).cast("int") % 32
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), digit(i) + 1, F.lit(1))), "")


def _first_of_equal(rows: DataFrame, least: int) -> DataFrame:
    """rows with ``first``, the smallest page_id of the rows of their payload, where there are several.

    Payloads of very many rows are few, and are sent to all executors; the rows of
    the others are joined by a shuffle, unless these are few too.
    """
    groups = rows.where(F.col("bytes") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1"), "payloads")
    facts = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).collect()[0]
    if facts["groups"] <= MOST_BROADCAST:
        return rows.join(F.broadcast(groups.select("sha1", "first")), "sha1", "left")
    # so many rows at least that no more than MOST_BROADCAST payloads can have them
    many = facts["rows"] // MOST_BROADCAST + 1
    hot, other = groups.where(F.col("n") >= many).select("sha1", "first", F.lit(True).alias("hot")), groups.where(F.col("n") < many).select("sha1", "first")
    marked = rows.join(F.broadcast(hot), "sha1", "left")
    rest = marked.where("hot is null").drop("first", "hot").join(other, "sha1", "left")
    return marked.where("hot").drop("hot").unionByName(rest)


def _packer(batches):
    """Each record as a gzip member, with the name of its archive: numbered within the task, a new one when the last is full."""
    task, archive, size, count = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        names, members = [], []
        for record in batch.column(0):
            if size >= ARCHIVE_BYTES or count >= RECORDS:
                archive, size, count = archive + 1, 0, 0
            member = gzip.compress(record.as_buffer(), compresslevel=6, mtime=0)
            size, count = size + len(member) + len(EMPTY_MEMBER), count + 1
            names.append(f"{task:06d}-{archive:06d}")
            members.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.binary())], names=["archive", "value"])


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """``(page_id, url, html)`` -> archives under path, a record per row.

    The payload is the html in UTF-8 (null: empty).  Of records with equal
    payloads of at least `least` bytes, that of the smallest page_id is a
    response and the others are revisits of it; smaller payloads are responses.
    Rows that repeat the smallest page_id are responses too, as are those without
    a page_id where none of the group has one.  A null url has no target line.
    Capture times are made from page_id, as pages have none.  A record is held
    whole by its task; an empty table writes no archive.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes"))
    known = _first_of_equal(rows, least)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    time = F.expr("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0), 315360000)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END), F.when(again, "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", time),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit(END),
    )
    members = known.select(record.cast("binary").alias("record")).mapInArrow(released(_packer), "archive string, value binary")
    sink = members.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive")
    sink.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: lower case, host labels reversed and joined by commas, then ')' and the rest."""
    lower = (url or "").lower()
    scheme, found, rest = lower.partition("://")
    if not found:
        return lower
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:at].split("."))) + ")" + rest[at:]


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member with content."""
    at, data = 0, memoryview(data)
    while at < len(data):
        one, parts, end = zlib.decompressobj(wbits=31), [], at
        while not one.eof:
            if end >= len(data):
                raise ValueError(f"member at {at} doesn't end")
            # short pieces: what stands beyond the member's end is copied
            parts.append(one.decompress(data[end : end + 16_384]))
            end = min(end + 16_384, len(data))
        end -= len(one.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header lines and block of a record."""
    end = END.encode()
    head, found, rest = record.partition(end)
    if not found or not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no record")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(lines["Content-Length"])
    if rest[size:] != end:
        raise ValueError("the record doesn't end where it says")
    return lines, rest[:size]


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def capture(head: dict[str, str], block: bytes) -> tuple:
    """The index fields of a record; a payload that doesn't match its digest is an error."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} isn't that of its digest")
    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
    time = head["WARC-Date"].translate(str.maketrans("", "", "-:TZ"))
    return _page(head["WARC-Record-ID"]), url_key(head.get("WARC-Target-URI")), time, size, digest, kind, refers


def _order(urlkey: str, captured: str, page_id: int | None) -> tuple:
    return urlkey, captured, -1 if page_id is None else page_id


def _schema():
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in _INDEX.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(), strict=True)], schema=_schema())


def _runs(batches):
    """The captures of each archive in order of URL key, time and page."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = "/".join(path.rsplit("/", 2)[1:])
            run = [(*capture(*parsed(record)), name, at, n) for at, n, record in members(content.as_buffer())]
            if run:
                yield _batch(sorted(run, key=lambda x: _order(x[1], x[2], x[0])))


class LoserTree:
    """k-way merge of sorted iterators: an inner node keeps the loser of its match, so a new value replays one path."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = list(runs), key
        self.k = max(len(self.runs), 1)
        self.values = [None] * self.k
        self.keys: list = [None] * self.k
        self.losers = [-1] * self.k
        for i in range(len(self.runs)):
            self._draw(i)
        self.winner = self._play(1)

    def _draw(self, i: int) -> None:
        self.values[i] = next(self.runs[i], None)
        self.keys[i] = None if self.values[i] is None else (self.key(self.values[i]), i)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None:
            return False
        return self.keys[b] is None or self.keys[a] < self.keys[b]

    def _play(self, root: int) -> int:
        winners = {}
        for node in range(2 * self.k - 1, root - 1, -1):
            if node >= self.k:
                winners[node] = node - self.k
            else:
                a, b = winners.pop(2 * node), winners.pop(2 * node + 1)
                winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        return winners.get(root, 0)

    def __iter__(self):
        return self

    def __next__(self):
        if self.keys[self.winner] is None:
            raise StopIteration
        i, value = self.winner, self.values[self.winner]
        self._draw(i)
        node = (i + self.k) // 2
        while node >= 1:
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i
        return value


def _merge(batches):
    """The rows of a range in order: runs, as they come, end where an archive ends or the order breaks."""
    batches, keys, begins, last = list(batches), [], [], None
    for batch in batches:
        for *key, archive in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "captured", "page_id", "archive")), strict=True):
            key = _order(*key)
            if archive != last or key < keys[-1]:
                begins.append(len(keys))
            keys.append(key)
            last = archive
    if keys:
        rows = pa.Table.from_batches(batches)
        tree = LoserTree([iter(range(a, b)) for a, b in zip(begins, [*begins[1:], len(keys)], strict=True)], keys.__getitem__)
        while some := list(itertools.islice(tree, 10_000)):
            yield from rows.take(pa.array(some)).combine_chunks().to_batches()


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path in global order of URL key, time and page.

    Rows stand in that order within each partition, and partitions are in order.
    offset and length are those of the record's member in its archive, a path
    below `path`.  A URL of very many captures is spread over ranges by time and
    page; a range is held by one task, and so is an archive.  No archives give no
    rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = stored(files.mapInArrow(released(_runs), _INDEX), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, "urlkey", "captured", "page_id").mapInArrow(released(_merge), _INDEX)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back and return their index."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return index(pages.sparkSession, path)
