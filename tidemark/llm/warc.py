"""WARC archives with revisit records, and an external merge of their capture runs.

Writing: pages of equal payload (of at least ``least_payload`` bytes) are found by their digest, aggregated
before anything is joined; the smallest page_id becomes the response, the others revisit it. Each task sorts
its captures by URL key and time and writes one archive, a gzip member per record.

Merging: reading an archive back gives a locally sorted run of captures. The runs are dealt by ranges of
(URL key, time, page), so a URL with very many captures spans ranges, and each range merges its k runs with
a loser tree. Ranges in order, and rows in order inside each, make the capture histories.

Pages have no capture time, so ``captured`` is a parameter: seconds since the epoch, in the query page_id (modulo
ten years) seconds after 2024-01-01 00:00:00 UTC. A time beyond the years 1 to 9999 is kept in a field of its own,
and its WARC-Date is the nearest that there is; a null one counts as 0. A null html counts as empty; a null url has an empty key and an empty
target; null page_ids are never preferred as response over a number, and refer by record id alone. Of
repeated rows with one page_id and payload, the first by url, then by place in the table, is the response. An
empty table writes no archive and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, open_filesystem, stored, table

LEAST_PAYLOAD = 100
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799  # of the years 1 and 9999
RANGE_ROWS = 100_000  # captures of a range, which a task merges
MANIFEST = "path string, records long"
CAPTURE = (
    "run string, place long, url_key string, captured long, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, record_id string, record_offset long, record_length long"
)
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, no scheme, user, www, default port or fragment, lower case."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?(?i:www\d?\.)?([^/?#:]*)(?::(?:80|443)(?=[/?#]|$))?(:\d+)?([^#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    path = F.lower(F.regexp_extract(url, pattern, 3))
    return F.concat(host, F.regexp_extract(url, pattern, 2), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def with_first(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages with digest, length, and the page that is the response for their payload (null: they are)."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.coalesce(F.col("captured").cast("long"), F.lit(0)).alias("captured"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("row").alias("row"))
    equal = pages.where(F.col("payload_bytes") >= least_payload).groupBy("payload_digest")
    equal = equal.agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("key"), "first")
    # Written first: Spark then splits the tasks of a payload that very many pages have.
    equal = stored(equal, "equal-payloads")
    key = F.when(F.col("payload_bytes") >= least_payload, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    joined = pages.withColumn("key", key).join(equal, "key", "left")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    html = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return joined.select("row", "page_id", "url", "captured", "payload_bytes", "payload_digest", html.alias("html"), revisit.alias("revisit"), F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"))


def _record_id(row: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row-{row}')}"


def _record(row: Any) -> bytes:
    from datetime import UTC, datetime

    date = datetime.fromtimestamp(min(max(row.captured, FIRST_SECOND), LAST_SECOND), UTC).isoformat().replace("+00:00", "Z")
    page = "" if row.page_id is None else str(row.page_id)
    target = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in row.url)
    body = RESPONSE_HEAD if row.revisit else RESPONSE_HEAD + row.html.encode("utf-8")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row.revisit else 'response'}", f"WARC-Record-ID: <{_record_id(row.row)}>",
        f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {page}", f"X-Url-Key: {row.url_key}", f"X-Captured: {row.captured}", f"X-Payload-Length: {row.payload_bytes}",
    ]
    if row.revisit:
        first = "" if row.first_page is None else str(row.first_page)
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_record_id(row.first_row)}>", f"X-Refers-To-Page: {first}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode("utf-8") + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least_payload: int = LEAST_PAYLOAD, level: int = 4) -> DataFrame:
    """Write all pages (page_id, url, html, captured); one row per archive.

    An archive appears under its final name in one move, so a task that runs again replaces it.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = open_filesystem(path)
        name, temporary = f"part-{part:06d}.warc.gz", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        sink, n = None, 0
        for batch in batches:
            batch = batch.astype({c: object for c in ("page_id", "first_page", "first_row")})
            batch = batch.where(batch.notna(), None)
            for row in batch.astype({"page_id": object}).itertuples(index=False):
                if sink is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(temporary, compression=None)
                row = row._replace(**{c: None if getattr(row, c) is None else int(getattr(row, c)) for c in ("page_id", "first_page", "first_row")})
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                sink.write(packer.compress(_record(row)) + packer.flush())
                n += 1
        if sink is not None:
            sink.close()
            system.move(temporary, f"{root}/{name}")
            yield pd.DataFrame({"path": [f"{path}/{name}"], "records": [n]})

    rows = with_first(pages, least_payload).withColumn("url_key", F.regexp_replace(url_key(F.col("url")), r"[\x00-\x1F\x7F]", "_"))
    return rows.sortWithinPartitions("url_key", "captured", "page_id", "row").mapInPandas(write, MANIFEST)


def members(source, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, packed length and content of each gzip member of a stream; holds one record at a time."""
    offset, ended = 0, False
    held = b""
    while True:
        unpacker, content, length = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = source.read(block)
                if not held:
                    ended = True
                    break
            content.append(unpacker.decompress(held))
            length += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        if ended:
            if length:
                raise ValueError("an archive ends inside a record")
            return
        yield offset, length, b"".join(content)
        offset += length


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """The captures of every archive, as its run: in the order of the file, with a place in it.

    The payload of a response is digested again and must match its header.
    """
    columns = [c.strip().split(" ")[0] for c in CAPTURE.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(text: str) -> int | None:
            return int(text) if text else None

        for batch in batches:
            for path in batch["path"]:
                system, name = open_filesystem(path)
                rows = []
                with system.open_input_stream(name, compression=None) as source:
                    for place, (offset, length, content) in enumerate(members(source)):
                        fields, block = parse(content)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(fields["x-payload-length"])
                        if fields["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the record at {offset} does not match its digest")
                        rows.append((
                            path, place, fields["x-url-key"], int(fields["x-captured"]), number(fields["x-page-id"]), fields["warc-target-uri"], fields["warc-type"],
                            size, digest, number(fields.get("x-refers-to-page", "")), fields["warc-record-id"].strip("<>"), offset, length,
                        ))
                        if len(rows) == 5_000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInPandas(read, CAPTURE)


class LoserTree:
    """Merges k sorted iterators of tuples; each step replays one path of log2 k matches.

    ``tree[1:]`` holds the loser of each match and ``tree[0]`` the winner; an iterator that is spent loses to
    all. Equal heads come in the order of their iterators.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held == -1 and building:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (head := self.heads[winner := self.tree[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order of URL key, time and page: ``history_part`` then ``history_place``.

    The number of ranges follows the number of captures, so a task holds about ``range_rows`` of them, each run's
    part of the range in its sorted order, however long the runs are.
    """
    columns = captures.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema) + ", history_part int, history_place long"

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, runs = TaskContext.get().partitionId(), {}
        for batch in batches:
            for run, rows in batch.groupby("run", sort=False):
                runs.setdefault(run, []).append(rows)

        def heads(k: int, parts: list[pd.DataFrame]) -> Iterator[tuple]:
            at = 0
            for rows in parts:
                known = rows["page_id"].notna()
                for key in zip(rows["url_key"], rows["captured"], known, rows["page_id"].fillna(0), rows["place"]):
                    yield (*key, k, at)
                    at += 1

        runs = dict(sorted(runs.items()))
        order = iter(LoserTree([heads(k, parts) for k, parts in enumerate(runs.values())]))
        tables = [pd.concat(parts, ignore_index=True) for parts in runs.values()]
        first = np.cumsum([0, *(len(t) for t in tables)])
        whole = pd.concat(tables, ignore_index=True) if tables else None
        place = 0
        while some := [first[k] + at for *_, k, at in islice(order, 10_000)]:
            out = whole.iloc[some].astype({"page_id": "Int64", "refers_to": "Int64"})
            yield out[columns].assign(history_part=part, history_place=range(place, place + len(out)))
            place += len(out)

    ranges = max(1, -(-captures.count() // range_rows))
    ranged = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "place")
    return ranged.sortWithinPartitions("run", "place").mapInPandas(merge, schema)


def archive_and_merge(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives, read their runs back, and merge these."""
    manifest = stored(write_archives(pages, path), "archives")
    return merge_runs(stored(read_archives(manifest), "runs"))


def op1(spark, sf_dir: str) -> DataFrame:
    """A record per page, read back from the archives in the order of the capture histories."""
    captured = F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315_360_000))
    pages = table(spark, sf_dir, "pages").withColumn("captured", captured.cast("long"))
    merged = archive_and_merge(pages, new_path(spark, "warc"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured")


QUERIES = {"op1_warc_index_merge": op1}
ORACLES = {
    "op1_warc_index_merge": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CAST(1704067200 + page_id % 315360000 AS BIGINT) AS captured FROM f"""
}
