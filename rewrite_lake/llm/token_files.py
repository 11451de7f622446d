"""Token ids in seekable zstandard files: independent frames, a seek table, checksums.

A file holds the ids of whole documents, little-endian, ``width`` bytes each:

* data frames, each compressed alone, of up to ``FRAME_IDS`` ids: documents are
  packed into frames until one is full; a longer document goes on in the next;
* a skippable frame (magic 0x184D2A50) with the index: per document its id, how
  many ids it has, compressed as a frame of its own;
* the seek table (magic 0x184D2A5E): per frame above the compressed and the plain
  size and the low 32 bits of XXH64 of the plain bytes, then the footer.

Any zstandard decoder yields the ids of a whole file; the reader looks at the
tail, picks the frames that hold wanted documents, and decompresses only those.

Writing is a data source with a commit: tasks write files under names of their
own, and the driver lists those of the tasks that won, with the number of ids
before each, in ``_files.json``.  Without that list the folder holds nothing.
Paths are what Arrow's file systems understand (``file:``, ``s3:``, ``gs:``,
``hdfs:`` or a plain path).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage)

from .common import read, scratch

#: Ids of a frame and of a file, at most (a document is not split over files); level of compression.
FRAME_IDS, FILE_IDS, LEVEL = 1 << 16, 1 << 25, 3
#: Words whose ids a worker remembers at once.
MEMO = 800_000
#: Fixed values of the seekable format.
SKIP, TABLE, FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LIST = "_files.json"
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

# --- encoding --------------------------------------------------------------------


#: The word pattern of the vocabularies whose texts can be cut at blanks, what it means in lower-case
#: Latin (code points below 0x180), and the characters that stand for unprintable bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo:
    """At most ``MEMO`` entries in two generations: those in use outlive a change of generation."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> bytes:
        if len(self.new) >= MEMO // 2:
            self.new, self.old = {}, self.new
        if len(key) <= 64:
            self.new[key] = ids
        return ids


class Encoder:
    """Ids of texts, by the library's tokenizer.

    Where the tokenizer's own file says that blanks are dropped and words cut by
    ``PATTERN``, a text's ids are those of its chunks between ASCII blanks, joined;
    chunks repeat, so each different one of a group of texts is cut once, and each
    worker remembers words (at most ``MEMO``).  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, cut = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        self.chunked = (
            [(x["type"], x.get("content")) for x in normal.get("normalizers", [])] == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and [x["type"] for x in cut.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and cut["pretokenizers"][0]["pattern"] == {"Regex": PATTERN} and cut["pretokenizers"][0]["invert"])
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.words = _Memo()

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, raw: bool) -> bytes:
        """Ids of one word: as it stands, or already spelt in the vocabulary's characters."""
        key = word if raw else "\0" + word
        ids = self.words.get(key)
        if ids is None:
            spelt = word if not raw or word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            ids = self.words.put(key, _packed([t.id for t in self.tokenizer.model.tokenize(spelt)]))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without blanks.  In printable Latin the normal form changes nothing but case."""
        word, known = chunk, self.words.new.get
        if chunk.isascii():
            if chunk.isalpha():
                word = chunk.lower()
                return known(word) or self._word(word, True)
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                word = chunk[:-1].lower()
                return (known(word) or self._word(word, True)) + self._word(chunk[-1], True)
        if chunk.isprintable() and (chunk.isascii() or (max(chunk) < "ƀ" and "İ" not in chunk)):
            return b"".join([known(w) or self._word(w, True) for w in _LATIN.findall(chunk.lower())])
        t = self.tokenizer
        return b"".join([self._word(w, False) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))])

    def texts(self, texts: pa.Array, end: list[int]) -> pa.Array:
        """The ids of each text and ``end``, as little-endian 32-bit integers (a binary array)."""
        import pyarrow.compute as pc
        if not self.chunked or any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added):
            return pa.array([self.whole(t) + _packed(end) for t in texts.to_pylist()], pa.binary())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known = [self._chunk(c) if c else b"" for c in coded.dictionary.to_pylist()]
        known.append(_packed(end))
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        table = np.frombuffer(b"".join(known), dtype="<u4")
        # each text's chunks, then the end's
        ends = np.cumsum(np.asarray(pc.list_value_length(split), dtype=np.int64))
        codes = np.insert(np.asarray(coded.indices), ends, len(known) - 1)
        n = size[codes]
        upto = np.cumsum(n)
        if upto[-1] < 1 << 31:  # half the memory for the places
            place = np.repeat(((np.cumsum(size) - size)[codes] - (upto - n)).astype(np.int32), n)
            place += np.arange(len(place), dtype=np.int32)
        else:
            place = np.repeat((np.cumsum(size) - size)[codes] - (upto - n), n)
            place += np.arange(len(place))
        bounds = np.concatenate([[0], upto[ends + np.arange(len(ends))]]) * 4
        flat = table[place]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(flat)]).cast(pa.binary())


_ENCODERS: dict[str, Encoder] = {}
#: Bytes of text encoded at once.
GROUP = 8 << 20


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """(doc_id, ids): the ids of every whole text and ``end_id`` after them, as little-endian 32-bit integers.

    ``path`` is a file of the tokenizers library, at the same place everywhere.
    Null texts are empty.  Rows keep their order; nothing else of ``docs`` is read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get(path)
        if coder is None:
            coder = _ENCODERS[path] = Encoder(path)
        end = [] if end_id is None else [end_id]
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            bounds = np.frombuffer(text.buffers()[1], dtype="<i8")[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP, side="right")) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), coder.texts(text.slice(at, to - at), end)], ["doc_id", "ids"])
                at = to
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, ids binary")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))

# --- one file --------------------------------------------------------------------


class FileWriter:
    """Appends documents to an open stream; ``close`` writes index and seek table."""

    def __init__(self, out, width: int):
        import zstandard
        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=LEVEL)
        self.entries, self.docs, self.counts, self.held, self.n_held, self.n_ids = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError(f"document {doc_id} has ids over 65535: write with width 4")
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        if self.n_held and self.n_held + len(ids) > FRAME_IDS:
            self._frame()
        at = 0
        while len(ids) - at > FRAME_IDS:  # only from an empty frame on
            self.held, self.n_held = [ids[at:at + FRAME_IDS]], FRAME_IDS
            self._frame()
            at += FRAME_IDS
        self.held.append(ids[at:])
        self.n_held += len(ids) - at

    def _frame(self) -> None:
        import xxhash
        plain = np.concatenate(self.held).astype(f"<u{self.width}").tobytes()
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        import xxhash
        if self.n_held:
            self._frame()
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        index = (struct.pack("<QQ", self.width, len(self.docs)) + known.tobytes()
                 + np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        body = self.zip.compress(index)
        self.out.write(struct.pack("<II", SKIP, len(body)) + body)
        self.entries.append((8 + len(body), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOT)
        self.out.write(struct.pack("<II", TABLE, len(table)) + table)


class FileReader:
    """An open file: its index, and the ids of the documents asked for."""

    def __init__(self, raw, size: int, name: str = ""):
        import zstandard
        self.raw, self.name, self.unzip, self.decoded = raw, name, zstandard.ZstdDecompressor(), 0
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT or not flags & 0x80:
            raise ValueError(f"{name}: no seek table with checksums")
        table = self._at(size - 9 - 12 * n - 8, 8 + 12 * n)
        if struct.unpack("<II", table[:8]) != (TABLE, 12 * n + 9):
            raise ValueError(f"{name}: broken seek table")
        self.entries = np.frombuffer(table[8:], dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        index = self._checked(n - 1, self._at(int(self.offset[n - 1]) + 8, int(self.entries[n - 1, 0]) - 8))
        self.width, docs = struct.unpack("<QQ", index[:16])
        known = np.frombuffer(index, np.uint8, docs, 16).astype(bool)
        ids = np.frombuffer(index, "<i8", docs, 16 + docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(index, "<u8", docs, 16 + 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frames = np.concatenate([[0], np.cumsum(self.entries[:-1, 1] // self.width)])  # ids before each frame

    def _at(self, at: int, n: int) -> bytes:
        self.raw.seek(at)
        got = self.raw.read(n)
        if len(got) != n:
            raise ValueError(f"{self.name}: breaks off")
        return got

    def _checked(self, frame: int, packed: bytes) -> bytes:
        import xxhash
        import zstandard
        try:
            plain = self.unzip.decompress(packed)
        except zstandard.ZstdError as e:
            raise ValueError(f"{self.name}: frame {frame} is damaged") from e
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[frame, 2]:
            raise ValueError(f"{self.name}: checksum of frame {frame} differs")
        return plain

    def ids(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of the documents at the ascending places ``wanted``; each frame is decompressed once."""
        now, data = -1, None
        for place in wanted:
            a, b = int(self.starts[place]), int(self.starts[place + 1])
            parts = []
            f = int(np.searchsorted(self.frames, a, side="right")) - 1
            while a < b:
                if f != now:
                    packed = self._at(int(self.offset[f]), int(self.entries[f, 0]))
                    data, now = np.frombuffer(self._checked(f, packed), dtype=f"<u{self.width}"), f
                    self.decoded += 1
                upto = min(b, int(self.frames[f + 1]))
                parts.append(data[a - int(self.frames[f]):upto - int(self.frames[f])])
                a, f = upto, f + 1
            yield place, np.concatenate(parts) if parts else np.zeros(0, dtype="<u2")

# --- the data source -------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if re.match(r"[a-zA-Z0-9]+:", path) else f"file://{path}")


class _Written(WriterCommitMessage):
    def __init__(self, task: int, files: list[dict]):
        self.task, self.files = task, files


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.width, self.file_ids = int(options.get("width", 4)), int(options.get("fileIds", FILE_IDS))
        if self.width not in (2, 4):
            raise ValueError("width is 2 or 4")

    def write(self, iterator):
        from pyspark import TaskContext
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task, attempt, files, open_ = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], [], None

        def close():
            writer, out, name = open_
            writer.close()
            out.close()
            known = [d for d in writer.docs if d is not None]
            files.append({"name": name, "n_docs": len(writer.docs), "n_ids": writer.n_ids, "least": min(known, default=None),
                          "most": max(known, default=None), "nulls": len(writer.docs) - len(known)})
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer() or b"", dtype="<u4")
                if open_ and open_[0].n_ids + len(ids) > self.file_ids:
                    close()
                    open_ = None
                if open_ is None:
                    name = f"ids-{self.job}-{task:06d}-{len(files):04d}-{attempt}.zst"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    open_ = FileWriter(out, self.width), out, name
                open_[0].add(doc_id, ids)
        if open_:
            close()
        return _Written(task, files)

    def _ours(self, store, root):
        from pyarrow import fs
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [x for x in found if x.is_file and x.base_name.startswith("ids-")]

    def commit(self, messages):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        if not self.overwrite and store.get_file_info(f"{root}/{LIST}").is_file:
            self.abort(messages)
            raise ValueError(f"{self.path} already holds token files")
        start, files = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for f in m.files:
                files.append(f | {"start": start})
                start += f["n_ids"]
        with store.open_output_stream(f"{root}/{LIST}", compression=None) as out:
            out.write(json.dumps({"width": self.width, "n_ids": start, "files": files}).encode())
        kept = {f["name"] for f in files}
        for x in self._ours(store, root):
            if x.base_name not in kept:  # of tasks that lost, or of the table written over
                store.delete_file(x.path)

    def abort(self, messages):
        store, root = _store(self.path)
        for x in self._ours(store, root):
            if x.base_name.startswith(f"ids-{self.job}-"):
                store.delete_file(x.path)


class _File(InputPartition):
    def __init__(self, file: dict):
        self.file = file


_TESTS = {EqualTo: lambda d, v: d is not None and d == v, In: lambda d, v: d is not None and d in v,
          GreaterThan: lambda d, v: d is not None and d > v, GreaterThanOrEqual: lambda d, v: d is not None and d >= v,
          LessThan: lambda d, v: d is not None and d < v, LessThanOrEqual: lambda d, v: d is not None and d <= v,
          EqualNullSafe: lambda d, v: d == v}


class TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.with_ids, self.filters = options["path"], str(options.get("ids", "true")).lower() == "true", []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (IsNull, IsNotNull, *_TESTS)) and f.attribute == ("doc_id",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, doc_id: int | None) -> bool:
        return all(doc_id is None if isinstance(f, IsNull) else doc_id is not None if isinstance(f, IsNotNull)
                   else _TESTS[type(f)](doc_id, f.value) for f in self.filters)

    def _may_hold(self, file: dict) -> bool:
        """Whether a file's span of ids can hold a wanted one."""
        if file["nulls"] or file["least"] is None:
            return True
        a, b = file["least"], file["most"]
        for f in self.filters:
            v = getattr(f, "value", None)
            if isinstance(f, IsNull) or (isinstance(f, EqualTo) and not a <= v <= b) or (isinstance(f, In) and not any(a <= x <= b for x in v)):
                return False
            if (isinstance(f, GreaterThan) and b <= v) or (isinstance(f, GreaterThanOrEqual) and b < v):
                return False
            if (isinstance(f, LessThan) and a >= v) or (isinstance(f, LessThanOrEqual) and a > v):
                return False
        return True

    def partitions(self):
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/{LIST}", compression=None) as raw:
            files = json.loads(raw.read())["files"]
        return [_File(f) for f in files if self._may_hold(f)] or [_File({})]

    def read(self, partition):
        file = partition.file
        if not file:
            return
        store, root = _store(self.path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        name = f"{root}/{file['name']}"
        with store.open_input_file(name) as raw:
            one = FileReader(raw, raw.size(), name)
            wanted = [i for i, d in enumerate(one.docs) if self._wanted(d)]
            found = one.ids(wanted) if self.with_ids else ((i, None) for i in wanted)
            rows, size = [], 0
            for i, ids in found:
                ids = None if ids is None else ids.astype("<u4").tobytes()
                rows.append({"doc_id": one.docs[i], "start": file["start"] + int(one.starts[i]), "n_tokens": int(one.counts[i]), "ids": ids})
                size += len(ids or b"") + 100
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class TokenSource(DataSource):
    """``format("token_ids")``; options: path, width (2 or 4), fileIds, ids (false: the index only)."""

    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenReader(self.options)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options, overwrite)


def write_ids(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
              width: int = 4, file_ids: int = FILE_IDS, parts: int | None = None) -> None:
    """Encode ``docs`` and write the ids in ascending id order (null first).

    Repeated ids stand side by side, ordered by a hash of their texts, each with
    ids of its own; null and empty texts have the end id alone.  Texts, not ids,
    are dealt by ranges of (id, hash), so a repeated id is spread too.  An empty
    table is a list of no files.
    """
    docs.sparkSession.dataSource.register(TokenSource)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    dealt = slim.repartitionByRange(parts, "doc_id", "h") if parts else slim.repartitionByRange("doc_id", "h")
    encode(dealt.sortWithinPartitions("doc_id", "h"), vocabulary, end_id=end_id).write.format("token_ids").option(
        "width", width).option("fileIds", file_ids).mode("append").save(path)


def read_ids(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian 32-bit integers, ``start`` the number of ids before.

    Conditions on doc_id are pushed: files and frames without a wanted document are
    neither read nor decompressed.  ``ids=False`` reads the indexes alone.
    """
    spark.dataSource.register(TokenSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("token_ids").option("ids", str(ids).lower()).load(path)


def op11_token_files(spark, sf_dir):
    path = scratch(spark, "ids")
    write_ids(read(spark, sf_dir, "documents"), path, vocabulary_path(), width=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_token_files": op11_token_files}
ORACLE: dict[str, str] = {}
