"""Web archives: a deterministic sharded writer and its reader.

Records are range-sorted by page and digest, between borders that depend on the rows alone
and not on how they are dealt to tasks; a shard rolls to its next file when the compressed
bytes reach a limit, headers and digests are made anew from the payload, and each file
appears by a rename. The manifest, written last, lists the files that count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientele.llm import files

DATE = "1970-01-01T00:00:00Z"          # the same input gives the same bytes
LEAST_SHARED = 100                     # shorter payloads are never stored as revisits
MANIFEST = "file string, records long, bytes long, sha256 string"
READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, " \
       "payload_digest string, intact boolean"
SAMPLED = 32                           # rows a shard from which its border is taken
_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
             ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _identity(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    # a line break inside an address would end the header
    target = "" if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    headers = [("WARC-Record-ID", _identity(page_id, digest) if refers_to is None else
                f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'again:{page_id}:{url}:{digest}')}>"),
               ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is None:
        http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n")
        return _record("response", [*headers, ("Content-Type", "application/http; msgtype=response")],
                       http.encode() + payload)
    return _record("revisit", [*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _identity(refers_to, digest)),
                               ("X-Refers-To-Page-ID", str(refers_to)),
                               ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")


class _Shard:
    """The files of one task; a file ends once its compressed bytes reach the limit."""

    def __init__(self, folder: str, number: int, limit: int):
        self.folder, self.number, self.limit, self.part = folder, number, limit, 0
        self.out = None
        self.done: list[tuple] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.number:05d}-{self.part:04d}.warc.gz"
            self.context = files.committed(self.folder, self.name)
            self.out, self.hash, self.size, self.count = self.context.__enter__(), hashlib.sha256(), 0, 0
            self._put(_record("warcinfo", [
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Date", DATE),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC 1.1\r\n"))
        self._put(record)
        self.count += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, record: bytes) -> None:
        # every record is a gzip member of its own
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.context.__exit__(None, None, None)
            self.done.append((self.name, self.count, self.size, self.hash.hexdigest()))
            self.out, self.part = None, self.part + 1


def _place(page_id: Column, digest: Column) -> Column:
    """Text that sorts as (page_id, digest), without page_id first."""
    signed = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(signed, F.lit("")), F.lit(" "), digest)


def borders(places: DataFrame, shards: int) -> list[str]:
    """The first place of each shard but the first, from the SAMPLED * shards places with
    the smallest hashes: equal rows in any order give equal borders."""
    found = places.select("place").orderBy(F.xxhash64("place"), "place").limit(SAMPLED * shards).collect()
    found = sorted(r["place"] for r in found)
    return [found[len(found) * i // shards] for i in range(1, shards)] if found else []


def write_warc(pages: DataFrame, folder: str, digests: str, shards: int, file_bytes: int = 64 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as archives below `folder`; returns the manifest.

    Null html is an empty payload. Of equal payloads of at least LEAST_SHARED bytes
    the record of the smallest page_id is the response; the others, and further rows
    with that very page_id, are revisits. Rows without page_id are written first.
    Rows with equal page_id go by digest, then url (null first). The same rows give the
    same files whatever order they come in. Other columns are left out. No page gives an
    empty manifest. `digests`: a path for the table of payload digests."""
    spark = pages.sparkSession
    files.make_folder(folder)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # Python's int here, so that the key of the rows and of the reference agree in type
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                         F.sha2(payload, 256).alias("digest"))
    pages.select("page_id", "digest", F.octet_length("payload").alias("size")).write.parquet(digests)
    hashed = spark.read.parquet(digests)
    first = np.array(borders(hashed.select(_place(F.col("page_id"), F.col("digest")).alias("place")), shards), "S")
    seen = hashed.where(F.col("size") >= LEAST_SHARED)
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    references = seen.join(firsts, "digest").select("page_id", "digest", "refers_to").distinct()
    # References travel beside the pages, so payloads are shuffled once, by the sort.
    both = pages.select("page_id", F.lit(1).alias("kind"), "url", "payload", "digest",
                        F.lit(None).cast("long").alias("refers_to")).unionByName(
        references.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                          F.lit(None).cast("binary").alias("payload"), "digest", "refers_to"))

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, place.to_numpy().astype("S"), "right").astype(np.int32))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, done, current = None, [], None
        for batch in batches:
            for number, page_id, kind, url, body, digest, refers_to in batch.itertuples(index=False, name=None):
                page_id = None if pd.isna(page_id) else int(page_id)
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(folder, number, file_bytes)
                    shard.done = done
                if current != (page_id, digest):
                    current, target, answered = (page_id, digest), None, False
                if kind == 0:
                    target = None if pd.isna(refers_to) else int(refers_to)
                    continue
                again = target if answered or target != page_id else None
                answered = True
                shard.add(_page_record(page_id, None if pd.isna(url) else url, bytes(body), digest, again))
        if shard is not None:
            shard.close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256"])

    # a shard has a number, and the partition of that number is its own
    written = (both.withColumn("place", _place(F.col("page_id"), F.col("digest"))).withColumn("shard", shard_of("place"))
               .repartitionById(shards, "shard").sortWithinPartitions("place", "kind", "url")
               .select("shard", "page_id", "kind", "url", "payload", "digest", "refers_to").mapInPandas(write, MANIFEST))
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    files.drop_temporary(folder)
    return spark.read.parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file one after the other."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        rest = rest or stream.read(_CHUNK)
        if not rest:
            return
        while not unpack.eof:
            if not rest:
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else stream.read(_CHUNK)
        yield b"".join(parts)


def _parse(member: bytes) -> tuple | None:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[:int(fields["Content-Length"])]
    intact = fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        intact = intact and hashlib.sha256(payload).hexdigest() == digest
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return (number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page-ID"), payload,
            None if payload is None else len(payload), digest, intact)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in the manifest. Revisits get the length of the payload
    they refer to; their own payload is null. `intact`: the digests fit the bytes."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, kinds = [f.split()[0] for f in READ.split(", ")], {0: "Int64", 3: "Int64", 5: "Int64"}

        def frame(rows):
            return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=kinds.get(i, object))
                                 for i, n in enumerate(names)})
        for batch in batches:
            for name in batch["file"]:
                rows, size = [], 0
                with files.open_file(folder, name) as stream:
                    for member in _members(stream):
                        if (row := _parse(member)) is not None:
                            rows.append(row)
                            size += len(member)
                        if size >= 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    # one task per file: a file is at most one roll size long
    tasks = max(1, len(files.sizes(folder, ".warc.gz")))
    return manifest.select("file").repartition(tasks, "file").mapInPandas(read, READ)


def resolved(records: DataFrame, folder: str) -> DataFrame:
    """Records without payloads, the payload length of revisits taken from their
    responses. `folder`: for the table of records, so that archives are read once and
    the join is planned on its real size."""
    spark = records.sparkSession
    records.drop("payload").write.parquet(folder)
    own = spark.read.parquet(folder)
    sizes = own.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).distinct()
    # a response holds its own length, so only revisits need the join
    return own.where("record_type = 'response'").unionByName(
        own.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
           .withColumn("payload_bytes", F.col("size")).drop("size"))
