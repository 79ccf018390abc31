"""WARC archives with revisit records, and a global capture index by external merge.

Pages become WARC/1.1 records, each a gzip member of its own, in one archive for each task. Beside its archive a task
writes a run: the index lines of its captures sorted by (URL key, timestamp, page_id). The runs are then merged
externally: the key space is cut at quantiles of the keys, and each merge task streams its part of all runs through a loser tree
and writes one segment of the index. Segments in order hold the capture history of every URL in global order. Records are read
back as the merged index says.

A run is a file of blocks of RUN_BLOCK captures (length, then zlib-compressed JSON lines), with the blocks' first keys and
offsets at its end, so a merge task reads no more than its part. Files carry names of their own and only those that tasks report
count, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import shared

RUN_BLOCK = 512
READ_BLOCK = 2_048
#: Runs that a task merges, and keys by which a run takes part in the quantiles.
FAN_IN, RUN_KEYS = 64, 16
#: Captures of so many bytes of an archive are read back by one task, one after another.
READ_BYTES = 16 << 20
#: Records of a synthetic capture carry this time plus page_id seconds, unless the pages have a timestamp column.
EPOCH = 1_704_067_200


def url_key(url: str | None) -> str:
    """A sortable key: host labels reversed, port, path and query, without scheme, `www.`, user, fragment and letter case."""
    text = (url or "").strip()
    rest = text.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    name, _, port = host.partition(":")
    name = name.removeprefix("www.").rstrip(".")
    port = "" if port in ("", "80", "443") else f":{port}"
    return f"{','.join(reversed(name.split('.')))}{port}){path.lower() or '/'}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, seconds: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record that points to another page's response and has no payload."""
    stamp = np.datetime_as_string(np.datetime64(seconds, "s")) + "Z"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def read_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member; the payload's digest is checked where there is one."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {version[:20]!r}")
    warc = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and (len(payload) != int(http["Content-Length"]) or digest_of(payload) != warc["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise ValueError("a payload does not fit its digest")
    return warc, http, payload


class LoserTree:
    """k-way merge of ascending iterators: an internal node keeps the loser of its match, so each item costs log2(k) comparisons."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether source a's head goes before b's; an ended source loses, equal heads go by source."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, source: int) -> None:
        winner, node = source, (source + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # its opponent has not come yet
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.sources[self.winner], None)
            self._play(self.winner)


def write_run(fs, path: str, captures: Iterable[tuple]) -> list[tuple]:
    """Write sorted captures as a run; returns the keys of all blocks."""
    blocks, at = [], 0
    with fs.open_output_stream(path) as f:
        for part in itertools.batched(captures, RUN_BLOCK):
            body = zlib.compress("\n".join(json.dumps(c) for c in part).encode(), 1)
            f.write(struct.pack("<I", len(body)) + body)
            blocks.append((part[0][:3], at))
            at += 4 + len(body)
        tail = json.dumps(blocks).encode()
        f.write(tail + struct.pack("<QQ", at, len(tail)))
    return [tuple(k) for k, _ in blocks]


def read_run(fs, path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run with low <= key < high (None: no bound), in order; reads only the blocks that may hold them."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - 16)
        end, size = struct.unpack("<QQ", f.read(16))
        f.seek(end)
        blocks = json.loads(f.read(size))
        first = max(0, bisect.bisect_left([tuple(k) for k, _ in blocks], low) - 1) if low is not None else 0
        for _, at in blocks[first:]:
            f.seek(at)
            for line in zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])).decode().split("\n"):
                capture = tuple(json.loads(line))
                if high is not None and capture[:3] >= high:
                    return
                if low is None or capture[:3] >= low:
                    yield capture


def read_files(fs, inner: str, files: list[tuple[str, tuple]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The same of a run of several files (name, first key), one after another; only those that may hold such captures are opened."""
    first = [key for _, key in files]
    begin = max(0, bisect.bisect_left(first, low) - 1) if low is not None else 0
    end = bisect.bisect_left(first, high) if high is not None else len(files)
    for name, _ in files[begin:end]:
        yield from read_run(fs, f"{inner}/{name}.run", low, high)


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary), seconds, refers_to of every page.

    Among pages with equal payloads of least_bytes or more the largest page_id is the response (rows that repeat it too, and all rows
    if their ids are null); the others refer to it. Payloads are compared by SHA-1 and length.
    """
    seconds = F.unix_timestamp("timestamp") if "timestamp" in pages.columns else F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"), seconds.cast("long").alias("seconds"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    best = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "best")
    joined = rows.join(best, ["sha", "size"], "left")
    other = F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("best")))
    return joined.select("page_id", "url", "html", "seconds", F.when(other, F.col("best")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> dict:
    """Write pages' archives and runs; returns {folder, runs: [{name, captures, keys}]} with the first key of every block of a run.

    pages: page_id, url, html, and timestamp if there is one. Null html is empty; null ids and URLs are kept as such.
    """
    folder = folder or shared.new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = shared.filesystem(folder)
        name, out, at, captures = f"captures-{uuid.uuid4().hex}", None, 0, []
        for batch in batches:
            for page_id, url, html, seconds, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(inner, recursive=True)
                    out = fs.open_output_stream(f"{inner}/{name}.warc.gz", compression=None)
                digest = digest_of(html)
                member = record(page_id, url, seconds, html, digest, refers_to)
                out.write(member)
                captures.append((url_key(url), seconds, -1 << 63 if page_id is None else page_id, at, len(member), len(html), digest, name))
                at += len(member)
        if out is not None:
            out.close()
            captures.sort()
            keys = write_run(fs, f"{inner}/{name}.run", captures)
            yield pa.RecordBatch.from_pydict({"name": [name], "captures": [len(captures)], "keys": [json.dumps(sampled(keys))]})

    made = with_references(pages, least_bytes).mapInArrow(run, "name string, captures long, keys string").collect()  # a row for each archive
    runs = sorted(((r["name"], [tuple(k) for k in json.loads(r["keys"])]) for r in made))
    return {"folder": folder, "captures": sum(r["captures"] for r in made), "runs": [{"files": [(name, keys[0])], "keys": keys} for name, keys in runs]}


def sampled(keys: list[tuple]) -> list[tuple]:
    """The first key and every so many of the others, RUN_KEYS to twice as many: a run's share in the quantiles."""
    return keys[:: max(1, len(keys) // RUN_KEYS)]


def quantiles(runs: list[dict], parts: int) -> list[tuple | None]:
    """Bounds of parts of about equal numbers of captures; None at both ends."""
    keys = sorted(k for r in runs for k in r["keys"])
    parts = max(1, min(parts, len(keys)))
    return [None, *sorted({keys[len(keys) * i // parts] for i in range(1, parts)}), None]


def fewer_runs(spark: SparkSession, archives: dict) -> dict:
    """archives with FAN_IN runs at most: passes in which each FAN_IN runs become one, a task for each range of keys of each group."""
    while len(archives["runs"]) > FAN_IN:
        runs, folder = archives["runs"], archives["folder"]
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        tasks = [(n, part, low, high) for n, group in enumerate(groups) for bounds in [quantiles(group, len(group))] for part, (low, high) in enumerate(zip(bounds, bounds[1:]))]
        shipped = spark.sparkContext.broadcast((tasks, [[r["files"] for r in g] for g in groups]))  # names and RUN_KEYS keys of each run

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tasks, files = shipped.value
            fs, inner = shared.filesystem(folder)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    n, part, low, high = tasks[t]
                    name = f"merged-{uuid.uuid4().hex}"
                    keys = write_run(fs, f"{inner}/{name}.run", LoserTree([read_files(fs, inner, f, low, high) for f in files[n]]))
                    if keys:
                        yield pa.RecordBatch.from_pydict({"group": [n], "part": [part], "name": [name], "keys": [json.dumps(sampled(keys))]})

        made = sorted(spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "group long, part long, name string, keys string").collect())  # a row for each file
        merged_runs: dict[int, dict] = {}
        for r in made:
            keys = [tuple(k) for k in json.loads(r["keys"])]
            now = merged_runs.setdefault(r["group"], {"files": [], "keys": []})
            now["files"].append((r["name"], keys[0]))
            now["keys"] += keys[:: max(1, len(groups[r["group"]]) // 2)]
        archives = archives | {"runs": [merged_runs[k] for k in sorted(merged_runs)]}
    return archives


def merged(spark: SparkSession, archives: dict, parts: int | None = None) -> DataFrame:
    """The captures of all runs in global order: part, at (place in the part), url_key, seconds, page_id, offset, length, payload_bytes, payload_digest, archive.

    Parts are ranges of the key; their bounds are quantiles of the runs' block keys. A merge task holds a block of each of FAN_IN runs at most; more runs are first
    merged into fewer, in passes.
    """
    archives = fewer_runs(spark, archives)
    bounds = quantiles(archives["runs"], parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, folder = len(bounds) - 1, archives["folder"]
    shipped = spark.sparkContext.broadcast([r["files"] for r in archives["runs"]])  # FAN_IN runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = shared.filesystem(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                low, high = bounds[part], bounds[part + 1]
                rows = []
                for at, c in enumerate(LoserTree([read_files(fs, inner, files, low, high) for files in shipped.value])):
                    rows.append((part, at, c[0], c[1], None if c[2] == -1 << 63 else c[2], *c[3:]))
                    if len(rows) == READ_BLOCK:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    types = {"part": "long", "at": "long", "url_key": "string", "seconds": "long", "page_id": "long", "offset": "long", "length": "long", "payload_bytes": "long", "payload_digest": "string", "archive": "string"}

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))

    return spark.range(0, parts, 1, parts).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key of each capture, from its record in the archive.

    The index, without payloads, is dealt out by stretches of the archives, so each archive is read from front to end by a few tasks. Digest and length of a response are those of the
    payload read; a revisit's are those of its headers, and must be those of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = shared.filesystem(folder)
        for batch in batches:
            rows = batch.to_pylist()
            out: list = [None] * len(rows)
            by_archive: dict[str, list[int]] = {}
            for i, r in enumerate(rows):
                by_archive.setdefault(r["archive"], []).append(i)
            for name, some in by_archive.items():
                with fs.open_input_file(f"{inner}/{name}.warc.gz") as f:
                    for i in sorted(some, key=lambda i: rows[i]["offset"]):
                        f.seek(rows[i]["offset"])
                        warc, http, payload = read_record(f.read(rows[i]["length"]))
                        kind = warc["WARC-Type"]
                        size = len(payload) if kind == "response" else int(http["Content-Length"])
                        digest = digest_of(payload) if kind == "response" else warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if (size, digest) != (rows[i]["payload_bytes"], rows[i]["payload_digest"]):
                            raise ValueError(f"{name}: the record at {rows[i]['offset']} is not the one of the index")
                        page = warc["X-Page-Id"]
                        refers = warc.get("X-Refers-To-Page-Id")
                        out[i] = (int(page) if page else None, size, digest, kind, int(refers) if refers else None, rows[i]["url_key"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key"])

    stretch = F.floor(F.col("offset") / READ_BYTES)
    near = index.select("url_key", "offset", "length", "payload_bytes", "payload_digest", "archive").repartition(F.col("archive"), stretch).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string")


def capture_histories(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All of it: write, merge, read back. Empty pages: no rows.

    Null html is empty, null ids and URLs stay null; payloads of any length are one record; rows that repeat an id are captures of their own. Other columns are ignored.
    """
    archives = write(pages, least_bytes=least_bytes)
    if not archives["runs"]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string")
    return read_back(merged(spark, archives), archives["folder"])
