"""Token ids as a binary output: one wavelet matrix per shard.

A shard is a run of documents in doc_id order. Its file holds the documents' ids and token counts and, for each bit of
the token ids from the highest down, one bit plane with rank counts; at every plane the ids are parted stably, zeros
first. So token access, counting and occurrence lookup read the planes alone, never the ids themselves.

File format, little-endian: magic ``WVM2``; uint32 planes; uint64 documents, tokens, bytes of the head; the head, a zstd
frame; then the planes' frames. The head holds per plane uint64 zeros; per frame of each plane its uint64 end among the
frames; per document uint64 tokens; the document ids as an Arrow stream. A frame is a zstd frame of ``FRAME`` bytes of one
plane (eight bits to a byte, highest first, the last zero-padded to whole blocks of 64 bytes) and, per block, a uint64
count of the plane's ones before it. A lookup inflates only the frames that it touches. Files are the values of column
``file`` of a Parquet table with one row per shard, so that they are written by Spark's committer, to any store that Spark
reaches.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import cut, sliced

END = 2
MAGIC = b"WVM2"
BLOCK = 64  # bytes of a plane that share one rank count
FRAME = 1 << 16  # bytes of a plane that are compressed together
_KNOWN = 700_000  # pieces that a worker remembers anew; as many older ones stay until these are full


def build(ids: np.ndarray, counts: np.ndarray, names: pa.Array | None = None, level: int = 1) -> bytes:
    """The file of a shard: ``ids`` are its tokens, ``counts`` the tokens of each document, ``names`` the documents' ids."""
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zstd = zstandard.ZstdCompressor(level=level)
    zeros, ends, body, at = [], [], [], 0
    for k in range(planes - 1, -1, -1):
        one = (now & now.dtype.type(1 << k)) != 0
        packed = np.packbits(one)
        packed = np.concatenate((packed, np.zeros(-len(packed) % BLOCK, np.uint8)))
        ones = np.bitwise_count(packed.reshape(-1, BLOCK)).sum(axis=1, dtype=np.uint64)
        before = np.cumsum(ones, dtype=np.uint64) - ones
        for f in range(0, len(packed), FRAME):
            body.append(zstd.compress(packed[f : f + FRAME].tobytes() + before[f // BLOCK : (f + FRAME) // BLOCK].tobytes()))
            at += len(body[-1])
            ends.append(at)
        low = now[np.flatnonzero(~one)]  # places are faster than masks here
        zeros.append(len(low))
        now = np.concatenate((low, now[np.flatnonzero(one)]))
    sink = pa.BufferOutputStream()
    names = pa.nulls(len(counts)) if names is None else names
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", names.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([names], names=["doc_id"]))
    head = zstd.compress(np.array([*zeros, *ends], "<u8").tobytes() + counts.astype("<u8").tobytes() + sink.getvalue().to_pybytes())
    return MAGIC + struct.pack("<IQQQ", planes, len(counts), len(ids), len(head)) + head + b"".join(body)


class WaveletMatrix:
    """Reads a shard's file."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.planes, docs, self.size, head = struct.unpack_from("<IQQQ", file, 4)
        self.width = -(-(-(-self.size // 8)) // BLOCK) * BLOCK  # bytes of a plane
        self.per_plane = -(-self.width // FRAME)
        raw = zstandard.ZstdDecompressor().decompress(file[32 : 32 + head])
        self.zeros = np.frombuffer(raw, "<u8", self.planes).astype(np.int64)
        at = 8 * self.planes
        self.ends = [32 + head, *(32 + head + np.frombuffer(raw, "<u8", self.planes * self.per_plane, at).astype(np.int64)).tolist()]
        at += 8 * self.planes * self.per_plane
        self.counts = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        with pa.ipc.open_stream(raw[at + 8 * docs :]) as stream:
            self.names = stream.read_next_batch().column(0)
        self.file = file
        self.inflated: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _frame(self, plane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits and rank counts of the ``n``-th frame of a plane."""
        k = plane * self.per_plane + n
        if k not in self.inflated:
            raw = zstandard.ZstdDecompressor().decompress(self.file[self.ends[k] : self.ends[k + 1]])
            bits = min(FRAME, self.width - n * FRAME)
            self.inflated[k] = np.frombuffer(raw, np.uint8, bits), np.frombuffer(raw, "<u8", bits // BLOCK, bits)
        return self.inflated[k]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        if i // 8 >= self.width:
            return self.size - int(self.zeros[plane])
        bits, ranks = self._frame(plane, i // 8 // FRAME)
        byte = i // 8 % FRAME
        block = byte // BLOCK
        ones = int(np.bitwise_count(bits[block * BLOCK : byte + 1]).sum()) - int(bits[byte] & (0xFF >> (i % 8))).bit_count()
        return int(ranks[block]) + ones

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        value = 0
        for k in range(self.planes):
            bits, _ = self._frame(k, i // 8 // FRAME)
            bit = int(bits[i // 8 % FRAME] >> (7 - i % 8) & 1)
            one = self._rank1(k, i)
            i = int(self.zeros[k]) + one if bit else i - one
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for k in range(self.planes):
            a, b = self._rank1(k, begin), self._rank1(k, end)
            begin, end = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (self.planes - 1 - k) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs at positions ``begin`` to before ``end``."""
        if token >> self.planes:
            return 0
        a, b = self._range(token, begin, self.size if end is None else end)
        return b - a

    def select(self, token: int, n: int) -> int:
        """The position of the ``n``-th occurrence of ``token``, from 0; -1 where there are no more."""
        if n < 0 or n >= self.count(token):
            return -1
        i = self._range(token, 0, 0)[0] + n
        for k in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - k) & 1
            want = i - int(self.zeros[k]) if one else i
            low, high = 0, self.size - 1  # the least position with ``want`` + 1 such bits up to it
            while low < high:
                mid = (low + high) // 2
                ones = self._rank1(k, mid + 1)
                low, high = (mid + 1, high) if (ones if one else mid + 1 - ones) <= want else (low, mid)
            i = low
        return i

    def decode(self) -> np.ndarray:
        """All tokens in order."""
        now = np.zeros(self.size, np.uint16 if self.planes <= 16 else np.uint32)
        for k in range(self.planes - 1, -1, -1):
            frames = [self._frame(k, n)[0] for n in range(self.per_plane)]
            one = np.unpackbits(np.concatenate(frames), count=self.size).astype(bool) if frames else np.zeros(0, bool)
            z = int(self.zeros[k])
            was = np.empty_like(now)
            was[np.flatnonzero(~one)] = now[:z]
            was[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.planes - 1 - k))
            now = was
        return now


class _Encoder:
    """Encodes texts with the tokenizers library.

    The vocabulary's pattern never joins a character with white space after it, so a text may be cut before any space
    that stands between two other characters, and at a line end between two words. A piece is encoded once and
    remembered. Latin letters with punctuation after them, which the pattern parts in two, go to the library's model
    directly; any other piece goes through the whole library. A text with runs of white space, other white space than
    spaces and line ends, or the content of an added token is encoded in one go.
    """

    ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
    MARKS = ".,;:!?"
    LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        added = self.library.get_added_tokens_decoder().values()
        # Content with white space could also arise where pieces meet; then every text is encoded in one go.
        self.added = [""] if any(c.isspace() for t in added for c in t.content) else [t.content for t in added]
        # The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.space = chr(self.alphabet[32])
        self.known = _Remembered(" ", self._piece, lambda piece: self.tokenize(self.space + piece))
        self.bare = _Remembered("", self._piece, self.tokenize)

    def odd(self, text: str) -> bool:
        return any(c in text for c in self.added) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or (any(c in text for c in self.ODD_ASCII) if text.isascii() else bool(self.ODD.search(text)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, text: str) -> bytes:
        """Ids of what the pattern keeps together."""
        if not text.isascii():
            text = text.encode().decode("latin-1")
        elif text.isalpha():
            return _ids([t.id for t in self.tokenize(text)])
        elif text[0] == " " and text[1:].isalpha():
            return _ids([t.id for t in self.tokenize(self.space + text[1:])])
        return _ids([t.id for t in self.tokenize(text.translate(self.alphabet))])

    def _piece(self, space: str, text: str, known: _Remembered) -> bytes:
        """Ids of a piece without spaces, after ``space``."""
        if "\n" in text:
            first, *more = text.split("\n")
            return known[first] + b"".join(self.bare["\n"] + self.bare[m] for m in more) if text != "\n" else self._together(text)
        letters = text.rstrip(self.MARKS)
        if self.LETTERS.fullmatch(letters):
            return self._together(space + letters) if letters == text else known[letters] + self.bare[text[len(letters) :]]
        return self._whole([space + text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids as little-endian 16-bit integers."""
        find, out = self.known.__getitem__, []
        for t in texts:
            if not t or self.odd(t):
                out.append(self._whole([t])[0])
            else:
                first, *pieces = t.split(" ")
                out.append(self.bare[first] + b"".join(map(find, pieces)))
        return out


_BIG = sys.byteorder == "big"


def _ids(ids: list[int]) -> bytes:
    a = array("H", ids)
    if _BIG:
        a.byteswap()
    return a.tobytes()


class _Remembered(dict):
    """What ``make`` gave for each piece: the newest ``_KNOWN`` pieces and, once these are full, those before them."""

    def __init__(self, space: str, make: Callable[[str, str, _Remembered], bytes], of_word: Callable[[str], list]):
        super().__init__()
        self.space, self.make, self.of_word, self.older = space, make, of_word, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            # A word of ASCII letters, as most are, is one part of the pattern.
            value = _ids([t.id for t in self.of_word(piece)]) if piece.isascii() and piece.isalpha() else self.make(self.space, piece, self)
        if len(self) >= _KNOWN:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, *, partitions: int | None = None, shard_tokens: int = 1 << 21, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as shard files in doc_id order (nulls first) and returns them as a table: part, shard, n_docs, n_tokens, file.

    Null texts are encoded as empty ones; every document ends with id 2. A shard takes documents until it holds
    ``shard_tokens`` tokens, so its size is bounded but for one long document. Rows with equal ids stay together in
    order of text. No rows: no shards. ``tokenizer`` is the path of a tokenizers file with at most 2**16 ids, the same on
    every executor. Other columns are ignored. The table is kept at ``path``, which must not exist yet; without one it is a scratch table.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder, end = _encoder(tokenizer), np.array([END], "<u2").tobytes()
        ids, held, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard
            file = build(np.frombuffer(b"".join(held), "<u2"), np.array(sizes), pa.array(ids, id_type))
            row = [[part], [shard], [len(sizes)], [total], [file]]
            shard += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        id_type, types = None, [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = ["part", "shard", "n_docs", "n_tokens", "file"]
        for batch, texts in sliced(batches, "_text"):
            id_type = batch.column(0).type
            for i, e in zip(batch.column(0).to_pylist(), encoder.encode([t.decode() for t in texts]), strict=True):
                ids.append(i)
                held.append(e + end)
                sizes.append(len(e) // 2 + 1)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield flush()
                    ids, held, sizes, total = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text")
    shards = rows.mapInArrow(run, "part int, shard int, n_docs int, n_tokens long, file binary")
    if path is None:
        return cut(shards, "token-shards")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_shards(shards: DataFrame, kind: str = "long", doc_id: str = "doc_id") -> DataFrame:
    """Reads the files of :func:`write_shards` back: doc_id (of type ``kind``), start (tokens of all documents before it), n_tokens and ids_crc32 for every document.

    Of the table only part, shard and n_tokens (for the order of the shards) and the file itself are used.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = cut(parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "token-parts")
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(shards.select("part", "shard", "n_tokens").withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
                 .join(parts, F.col("part") == F.col("_part")).select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), (F.col("_base") + F.col("_in")).alias("_start")), "token-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                matrix = WaveletMatrix(row.column(0)[0].as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.counts)
                first = ends - matrix.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([matrix.names, pa.array(row.column(1)[0].as_py() + first), pa.array(matrix.counts), pa.array(crc, pa.int64())], names=[doc_id, "start", "n_tokens", "ids_crc32"])

    joined = shards.join(starts, (shards["part"] == starts["_part"]) & (shards["shard"] == starts["_shard"])).select("file", "_start")
    return joined.mapInArrow(run, f"{doc_id} {kind}, start long, n_tokens long, ids_crc32 long")
