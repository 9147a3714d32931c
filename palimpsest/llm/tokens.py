"""Token ids of whole texts, and their file format: length-delimited records with an offset index."""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, table

#: Id that ends each document.
END = 0
#: Bytes of text that a file of records holds, at about a third or half of them in ids.
FILE = 512 << 20
#: Pieces whose ids an encoder remembers before it starts anew; at some 200 bytes each.
MEMO = 1_000_000


def vocabulary() -> str:
    """The default tokenizer file; its place is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo(dict):
    """Ids by piece; a piece that isn't known is encoded and remembered, so that a text is one pass of look-ups."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        # Long pieces don't repeat.
        if len(piece) < 40:
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    The byte-level pre-tokenizer always starts a new unit at a space that a non-space follows, so a text is cut there and
    the ids of up to MEMO pieces are remembered: a new piece is cut by the pre-tokenizer's pattern and merged unit by unit
    by the library's model. Tokenizers of another kind, and texts that hold a special token or white space of
    another kind, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.pieces = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec.get("post_processor")
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and sys.byteorder == "little"
            and array("I").itemsize == 4
        )
        self.added = [x["content"] for x in spec.get("added_tokens") or ()]
        # White space other than single spaces and line ends within the text; such texts are encoded whole.
        self.odd = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["  ", " \n"]
        self.odd += self.added
        # The unit pattern and the alphabet of byte-level pre-tokenizers.
        self.unit = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        # Printable Latin-1 stands for itself, other bytes follow from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.space = chr(self.alphabet[32])
        self.merge = self.whole.model.tokenize
        self.bare = Memo(lambda piece: self._piece(piece, ""))  # pieces at a text's or line's start
        self.spaced = Memo(lambda piece: self._piece(piece, " "))  # pieces after a space

    def _merged(self, unit: str) -> bytes:
        """Ids of a unit of the pre-tokenizer."""
        return array("I", [t.id for t in self.merge(unit.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _piece(self, piece: str, lead: str) -> bytes:
        """Ids of a piece without spaces, after ``lead``."""
        if piece.isalpha():
            if piece.isascii():
                return array("I", [t.id for t in self.merge(self.space + piece if lead else piece)]).tobytes()
            return self._merged(lead + piece)
        if piece[:-1].isalpha():
            return (self.spaced if lead else self.bare)[piece[:-1]] + self.bare[piece[-1]]
        if "\n" in piece[1:] and "\n\n" not in piece and piece[0] != "\n":
            line, _, rest = piece.partition("\n")
            found = (self.spaced if lead else self.bare)[line] + self._merged("\n")
            return found + self.bare[rest] if rest else found
        return b"".join(map(self._merged, self.unit.findall(lead + piece)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if not self.pieces or text[0].isspace() or text[-1] == " " or any(map(text.__contains__, self.odd)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        for memo in (self.bare, self.spaced):
            if len(memo) >= MEMO:
                memo.clear()
        head, *pieces = text.split(" ")
        return self.bare[head] + b"".join(map(self.spaced.__getitem__, pieces))

    def document(self, text: str | None) -> bytes:
        return self.encode(text or "") + struct.pack("<I", END)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# The file format. A file has records one after another:
#   length  unsigned 64-bit, little endian: bytes of the data
#   check   unsigned 32-bit: masked CRC-32 of the eight length bytes
#   data    8-byte signed document number, 1 byte width of an id (2 or 4; plus 128 if the document has no number), then
#           the ids, little endian and unsigned
#   check   unsigned 32-bit: masked CRC-32 of the data
# Beside it lies an index of fixed-size entries (document, offset of the record, ids in it), for reads in any order.
# A masked check is the CRC rotated right by 15 bits plus a constant, so that a CRC of data with CRCs stays sound.
MASK = 0xA282EAD8
LENGTH, CHECK, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
ENTRY = np.dtype([("doc", "<i8"), ("at", "<u8"), ("ids", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc: int | None, ids: bytes, width: int) -> bytes:
    """A record; ``ids`` are 32-bit, written in ``width`` bytes each."""
    data = HEAD.pack(doc or 0, width if doc is not None else width | 128) + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)
    length = LENGTH.pack(len(data))
    return b"".join((length, CHECK.pack(masked(length)), data, CHECK.pack(masked(data))))


def unframe(buffer: memoryview | bytes, at: int = 0) -> tuple[int | None, bytes, int]:
    """(document, 32-bit ids, offset of the next record); ValueError if a check fails."""
    view = memoryview(buffer)
    if len(view) < at + 12:
        raise ValueError("a record's head is cut off")
    length = bytes(view[at : at + 8])
    if CHECK.unpack_from(view, at + 8)[0] != masked(length):
        raise ValueError(f"the length at {at} is damaged")
    size = LENGTH.unpack(length)[0]
    end = at + 12 + size
    if len(view) < end + 4:
        raise ValueError(f"the record at {at} is cut off")
    data = bytes(view[at + 12 : end])
    if CHECK.unpack_from(view, end)[0] != masked(data):
        raise ValueError(f"the record at {at} is damaged")
    doc, width = HEAD.unpack_from(data)
    ids = data[HEAD.size :]
    doc = None if width & 128 else doc
    if width & 127 == 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return doc, ids, end + 4


def _store(uri: str):
    """(file system, path in it) of a folder in a local, HDFS or object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def file_count(texts: DataFrame, column: str) -> int:
    """Files for a column of texts: one for FILE bytes of it, and as many as the session's shuffles have partitions at least."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    parts: int | None = None,
    width: int = 2,
) -> DataFrame:
    """Writes the documents in ascending ``key`` order as ``part-NNNNN.rec`` with ``part-NNNNN.idx`` and returns the
    manifest (part, records, ids).

    Rows are dealt by ranges of (key, hash of the text, place in the input), a file each, so neither a key nor a repeated
    row, however frequent, is bound to one file; ``parts`` is the number of ranges, by default from the bytes of the texts.
    Rows of equal key are ordered by a hash of their text. A file is written under a name of its own and renamed when whole,
    so a task that runs again or twice does no harm; what failed attempts have left is removed at the end. ``width`` is the
    bytes of an id; an id that doesn't fit raises an error. Null texts count as empty; null keys come first; rows that
    repeat are written as often as they occur; other columns are ignored; an empty table gives empty files.
    """
    path = path or vocabulary()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    parts = parts or file_count(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _store(folder)
        name = f"{base}/part-{task.partitionId():05d}"
        own = f"{base}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        store.create_dir(base, recursive=True)
        enc, entries, at, records, total = encoder(path), [], 0, 0, 0
        with store.open_output_stream(own + ".rec") as file:
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = enc.document(body.as_py())
                    if width == 2 and len(ids) and int(np.frombuffer(ids, "<u4").max()) > 0xFFFF:
                        raise ValueError("an id doesn't fit in two bytes")
                    record = frame(doc, ids, width)
                    file.write(record)
                    entries.append((doc or 0, at, len(ids) // 4))
                    at, records, total = at + len(record), records + 1, total + len(ids) // 4
        with store.open_output_stream(own + ".idx") as file:
            file.write(np.array(entries, dtype=ENTRY).tobytes())
        for end in (".rec", ".idx"):
            store.move(own + end, name + end)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int64()), pa.array([records], pa.int64()), pa.array([total], pa.int64())],
            names=["part", "records", "ids"],
        )

    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "id", "hash", "place").sortWithinPartitions("id", "hash").select("id", "text")
    manifest = cut(dealt.mapInArrow(run, "part long, records long, ids long"), "manifest")
    sweep(folder)
    return manifest


def sweep(folder: str) -> None:
    """Removes the files that attempts which didn't end have left."""
    from pyarrow.fs import FileSelector

    store, base = _store(folder)
    for info in store.get_file_info(FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("."):
            store.delete_file(info.path)


def records(store, name: str, index: np.ndarray, wanted: np.ndarray, step: int) -> Iterator[tuple[int, int | None, bytes]]:
    """(i, document, ids) of the entries ``wanted`` of a file's index, which ascend; neighbours are read together, about
    ``step`` bytes at a time."""
    with store.open_input_file(name + ".rec") as file:
        bounds = np.r_[index["at"], file.size()].astype(np.int64)
        i = 0
        while i < len(wanted):
            j = i + 1
            while j < len(wanted) and wanted[j] == wanted[j - 1] + 1 and bounds[wanted[j] + 1] - bounds[wanted[i]] <= step:
                j += 1
            first = int(bounds[wanted[i]])
            buffer = file.read_at(int(bounds[wanted[j - 1] + 1]) - first, first)
            for k in wanted[i:j]:
                doc, ids, _ = unframe(buffer, int(bounds[k]) - first)
                if (doc or 0) != index["doc"][k] or len(ids) // 4 != index["ids"][k]:
                    raise ValueError(f"the index of {name} doesn't match record {k}")
                yield int(k), doc, ids
            i = j


def index_of(store, name: str) -> np.ndarray:
    with store.open_input_file(name + ".idx") as file:
        return np.frombuffer(file.read(), dtype=ENTRY)


def read_token_files(manifest: DataFrame, folder: str, step: int = 8 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every record of the files, checked; ``start``: ids of all before it.

    A file is read in steps of about ``step`` bytes, by its index. An empty manifest gives an empty result.
    """
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each file.
    files = manifest.where("records > 0").select("part", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/part-{part:05d}"
                index = index_of(store, name)
                out, held = [], 0
                for k, doc, ids in records(store, name, index, np.arange(len(index)), step):
                    out.append((doc, start, len(ids) // 4, zlib.crc32(ids), ids))
                    start, held = start + len(ids) // 4, held + len(ids)
                    if held >= step or k == len(index) - 1:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )
                        out, held = [], 0

    return files.repartition(max(1, files.count()), "part").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def read_shuffled(manifest: DataFrame, folder: str, seed: int = 0, step: int = 8 << 20) -> DataFrame:
    """(place, doc_id, ids): every record once, each partition in ascending ``place``, a seeded pseudo-random number that
    orders all records, as a trainer reads an epoch. Only entries of the indexes are shuffled; a task reads its records
    through the offsets of the index, those of a file in one pass. An empty manifest gives an empty result.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                n = len(index_of(store, f"{base}/part-{part:05d}"))
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64())], names=["part", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            place, part, record = (batch.column(i).to_numpy() for i in range(3))
            found: list = [None] * len(place)
            for p in np.unique(part):
                name = f"{base}/part-{p:05d}"
                rows = np.flatnonzero(part == p)
                rows = rows[np.argsort(record[rows])]
                for i, (_, doc, ids) in zip(rows, records(store, name, index_of(store, name), record[rows], step), strict=True):
                    found[i] = (doc, ids)
            docs, bodies = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(docs, pa.int64()), pa.array(bodies, pa.binary())], names=["place", "doc_id", "ids"]
            )

    parts = max(1, manifest.where("records > 0").count())
    rows = manifest.where("records > 0").select("part").repartition(parts, "part").mapInArrow(entries, "part long, record long")
    rows = rows.select(F.xxhash64(F.lit(seed), "part", "record").alias("place"), "part", "record")
    return rows.repartitionByRange(parts, "place").sortWithinPartitions("place").mapInArrow(run, "place long, doc_id long, ids binary")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents, from the files that :func:`write_token_files` has written; nulls,
    ties and empty tables as there."""
    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
