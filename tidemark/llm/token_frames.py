"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in ascending order of document:

* zstandard frames, each with the ids of some whole documents (little-endian, 16 bits where the
  vocabulary allows it, else 32). A document longer than a frame has a frame of its own;
* a skippable frame (magic 0x184D2A50) with the document index, itself zstandard-compressed:
  doc_id, frame, first id in the frame, number of ids;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format: compressed
  size, decompressed size and the low 32 bits of XXH64 of each frame's content, then the footer.

``write_tokens`` sorts the documents over the cluster and writes a file per partition;
``read_tokens`` reads files back, checks every frame, and ``read_documents`` decompresses only the
frames of the documents asked for. A null text counts as empty, so it holds the end id alone; a null
doc_id sorts first and comes back as null; repeated doc_ids stay, ordered by a hash of their text; an
empty table gives no file and no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import END_ID, default_vocabulary, encoder
from tidemark.llm.shared import new_path, open_filesystem, parts_for, stored, table, text_volume

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

NO_ID = -(2**63)
INDEX_TYPE = np.dtype([("doc", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
MANIFEST = "path string, part int, first_doc long, docs long, tokens long"
ENCODED = "doc_id long, local_start long, n_tokens long, ids_crc32 long"


class FrameChecksumError(ValueError):
    """A frame's content does not match the checksum in the seek table."""


class FrameWriter:
    """Appends documents to one file; a frame closes once it holds ``frame_ids`` ids."""

    def __init__(self, sink, frame_ids: int, width: int, level: int):
        import zstandard

        self.sink, self.frame_ids, self.type = sink, frame_ids, np.dtype(f"<u{width}")
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.in_frame = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.tokens = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.rows.append((doc, len(self.seek), self.in_frame, len(ids)))
        self.held.append(ids.astype(self.type))
        self.in_frame += len(ids)
        self.tokens += len(ids)
        if self.in_frame >= self.frame_ids:
            self._close_frame()
        if len(self.rows) >= 65_536:
            self._pack_rows()

    def _pack_rows(self) -> None:
        if self.rows:
            self.index.append(np.array(self.rows, dtype=INDEX_TYPE))
            self.rows = []

    def _close_frame(self) -> None:
        import xxhash

        if not self.held:
            return
        content = np.concatenate(self.held).tobytes()
        packed = self.compressor.compress(content)
        self.sink.write(packed)
        self.seek.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.held, self.in_frame = [], 0

    def close(self) -> tuple[int, int, int]:
        """Number of documents, of ids, and the first document."""
        self._close_frame()
        self._pack_rows()
        index = np.concatenate(self.index) if self.index else np.empty(0, INDEX_TYPE)
        body = struct.pack("<B", self.type.itemsize) + self.compressor.compress(index.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        entries = np.array(self.seek, dtype="<u4").tobytes()
        footer = struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)
        return len(index), self.tokens, int(index["doc"][0]) if len(index) else NO_ID


@dataclass
class FrameFile:
    """A file of frames, of which only the two tables at its end have been read."""

    source: object
    seek: np.ndarray
    starts: np.ndarray
    index: np.ndarray
    type: np.dtype

    @classmethod
    def open(cls, path: str) -> FrameFile:
        import zstandard

        system, name = open_filesystem(path)
        source = system.open_input_file(name)
        size = source.size()
        frames, flag, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        seek_at = size - 9 - 12 * frames - 8
        seek = np.frombuffer(source.read_at(12 * frames, seek_at + 8), "<u4").reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum(seek[:, 0], dtype=np.int64)])
        index_at = int(starts[-1])
        kind, length = struct.unpack("<II", source.read_at(8, index_at))
        if kind != SKIPPABLE_INDEX or index_at + 8 + length != seek_at:
            raise ValueError(f"{path} has no document index")
        body = source.read_at(length, index_at + 8)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), INDEX_TYPE)
        return cls(source, seek, starts, index, np.dtype(f"<u{body[0]}"))

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        packed = self.source.read_at(int(self.seek[k, 0]), int(self.starts[k]))
        content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.seek[k, 1]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.seek[k, 2]):
            raise FrameChecksumError(f"frame {k}")
        return np.frombuffer(content, self.type)

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, ids of the file before it, and its ids; frames without a wanted document stay packed."""
        before = np.concatenate([[0], np.cumsum(self.index["n"], dtype=np.int64)])
        rows = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["doc"], wanted))
        held, ids = -1, np.empty(0, self.type)
        for r in rows:
            doc, frame, at, n = self.index[r].item()
            if frame != held:
                held, ids = frame, self.frame(frame)
            yield doc, int(before[r]), ids[at : at + n]


def write_tokens(
    documents: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, frame_ids: int = 65_536, width: int = 2, level: int = 3, added: bool = False
) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; one row per file.

    The texts are dealt by ranges of (doc_id, hash of the text), so one repeated doc_id does not fill a
    task. A file appears under its final name in one move: a task that runs again replaces it by the
    same content. ``added`` takes added tokens in a text as the library does by default.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary, added).encode
        end = np.array([end_id], dtype="<u4")
        writer = sink = None
        system, root = open_filesystem(path)
        final, temporary = f"{root}/part-{part:06d}.tok.zst", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids = batch["doc_id"]
            docs = ids.fillna(NO_ID).astype("int64").tolist() if ids.isna().any() else ids.tolist()
            texts = batch["text"].tolist()
            for a in range(0, len(docs), 512):
                for doc, packed in zip(docs[a : a + 512], encode(texts[a : a + 512])):
                    if writer is None:
                        system.create_dir(root, recursive=True)
                        sink = system.open_output_stream(temporary)
                        writer = FrameWriter(sink, frame_ids, width, level)
                    writer.add(doc, np.concatenate([np.frombuffer(packed, "<u4"), end]))
        if writer is not None:
            n, tokens, first = writer.close()
            sink.close()
            system.move(temporary, final)
            yield pd.DataFrame([(f"{path}/part-{part:06d}.tok.zst", part, first, n, tokens)], columns=["path", "part", "first_doc", "docs", "tokens"])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts_for(text_volume(documents)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInPandas(write, MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, ids_crc32.

    The manifest has a row per file, so the running sum over it stays small however long the files are.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, offset in zip(batch["path"], batch["file_start"]):
                rows = []
                for doc, before, ids in FrameFile.open(path).documents():
                    rows.append((doc, int(offset) + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    def _frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        out["doc_id"] = out["doc_id"].astype("Int64").mask(out["doc_id"] == NO_ID)
        return out

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("file_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted documents (column doc_id), reading only the frames that hold them.

    ``wanted`` is matched to files by doc_id range, and a file gets only its own part of the list.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path"):
                rows = [(doc, ids.astype("int64").tolist()) for doc, _, ids in FrameFile.open(path).documents(part["doc_id"].to_numpy("int64"))]
                yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    last = F.lead("first_doc").over(Window.orderBy("part"))
    files = manifest.withColumn("last_doc", F.coalesce(last, F.lit(2**63 - 1))).select("path", "first_doc", "last_doc")
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    hit = ids.join(files, (F.col("doc_id") >= F.col("first_doc")) & (F.col("doc_id") <= F.col("last_doc")))
    return hit.repartition("path").sortWithinPartitions("path").mapInPandas(read, "doc_id long, ids array<long>")


def op3(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded, written to frames in ascending doc_id order, and read back."""
    documents = table(spark, sf_dir, "documents")
    manifest = stored(write_tokens(documents, new_path(spark, "tokens"), default_vocabulary(), added=True), "token-files")
    return read_tokens(manifest)


QUERIES = {"op3_token_frames": op3}
