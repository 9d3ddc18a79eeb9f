"""Token ids as wavelet-matrix shards: access, counting and occurrence lookup from one compressed file.

Documents are ordered by id with a range shuffle; each task encodes its texts and
cuts them into shards of whole documents. A shard is one byte string: a header,
document ids and lengths, and sixteen bit-planes with rank directories. The shards
are the rows of a Parquet table, so any executor reads any of them by itself.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_count import byte_symbols
from .common import join_small, python_batches, stage

MAGIC = b"WVMX1\0"
WIDTH = 16
#: Bits between entries of a rank directory.
STRIDE = 2048
#: Tokens after which a shard is closed (after a whole document).
SHARD_TOKENS = 1 << 18
#: Words whose ids a worker keeps, and the longest that is kept.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 48
#: White space other than the blank and the line feed, in ASCII and beyond.
_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Signs that end a word as a pre-token of their own.
_SIGNS = (".", ",", ";", ":", "!", "?")
_DOUBLE_SPACE = re.compile(r"\s\s")


def _has_double_space(text: str) -> bool:
    """Whether two white-space characters stand side by side, or one begins or ends the text."""
    if text[0].isspace() or text[-1].isspace():
        return True
    if any(c in text for c in _ASCII_SPACES) or not text.isascii() and any(c in text for c in _OTHER_SPACES):
        return _DOUBLE_SPACE.search(text) is not None
    return "  " in text or "\n" in text and (" \n" in text or "\n " in text or "\n\n" in text)


class _Kept(dict):
    """Ids by word; a word that is not there is encoded, and kept unless it is long.

    When half of the words that may be kept are there, they become the old ones, and
    those that are asked again come back from them; the rest is dropped at the next turn.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class WordEncoder:
    """Ids of whole texts from the tokenizers library, each recurring word encoded once.

    A byte-level pre-tokenizer begins a token at a blank between two other characters
    and makes a line feed between two a token of its own, so there a text's ids are
    those of its words one after another. A word of letters is one pre-token and goes
    straight to the library's merge model, another word to the whole library. Texts
    with double white space or an added token go to the library whole, as do all
    texts where the file has another pre-tokenizer or a normalizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.merge = self.library.model.tokenize
        self.marks = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.symbols = dict(enumerate(byte_symbols()))
        self.blank = self.symbols[ord(" ")]
        self.feed = self.whole("\n")
        #: Ids of words after a blank, and of words that begin a line.
        self.after, self.first = _Kept(lambda w: self._word(w, " ")), _Kept(lambda w: self._word(w, ""))

    def whole(self, text: str) -> bytes:
        """The library's ids of a text."""
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, before: str) -> bytes:
        """Ids of a word of letters alone, with the blank before it if there is one."""
        symbols = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.symbols)
        return array("H", [t.id for t in self.merge(self.blank + symbols if before else symbols)]).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        if word.isalpha():
            return self._letters(word, before)
        if word[-1] in _SIGNS and word[:-1].isalpha():
            body = (self.after if before else self.first).get(word[:-1])
            return (body or self._letters(word[:-1], before)) + self._sign(word[-1])
        return self.whole(before + word)

    @lru_cache(maxsize=64)  # noqa: B019 - one encoder a worker
    def _sign(self, sign: str) -> bytes:
        return self.whole(sign)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as unsigned 16-bit integers; a null text has none."""
        if not text:
            return b""
        if not self.by_word or _has_double_space(text) or any(m in text for m in self.marks):
            return self.whole(text)
        after, first, out = self.after.__getitem__, self.first.__getitem__, []
        for line in text.split("\n"):
            words = iter(line.split(" "))
            out.append(first(next(words)))
            out += map(after, words)
            out.append(self.feed)
        out.pop()
        return b"".join(out)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process; what it keeps serves later tasks too."""
    return WordEncoder(path)


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard of the documents ``doc_ids`` whose ``lengths`` tokens stand one after another in ``ids``."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    parts: list[bytes] = []

    def add(data: bytes) -> None:
        parts.append(struct.pack("<I", len(data)) + data)

    add(pack(np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes()))
    add(pack(np.array([i is None for i in doc_ids], dtype="u1").tobytes()))
    add(pack(np.array(lengths, dtype="<u4").tobytes()))
    row = np.ascontiguousarray(ids, dtype=np.uint16)
    for k in range(WIDTH - 1, -1, -1):
        one = (row & np.uint16(1 << k)) != 0
        if not one.any():
            add(struct.pack("<I", len(row)))  # a plane of zeros needs neither bits nor a directory
            continue
        packed = np.packbits(one, bitorder="little")
        padded = np.zeros(-(-len(packed) // (STRIDE // 8)) * (STRIDE // 8), dtype=np.uint8)
        padded[: len(packed)] = packed
        ranks = np.cumsum(np.bitwise_count(padded).reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        add(_plane(len(row) - int(ranks[-1]), pack(ranks.astype("<u4").tobytes()), pack(packed.tobytes())))
        row = np.concatenate([np.compress(~one, row), np.compress(one, row)])
    return MAGIC + struct.pack("<QQ", len(doc_ids), len(ids)) + b"".join(parts)


def _plane(zeros: int, ranks: bytes, bits: bytes) -> bytes:
    return struct.pack("<II", zeros, len(ranks)) + ranks + bits


class Shard:
    """A shard read from its bytes. Planes are unpacked when first asked for."""

    def __init__(self, data: bytes):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        f = io.BytesIO(data)
        f.seek(len(MAGIC))
        self.n_docs, self.n = struct.unpack("<QQ", f.read(16))

        def part() -> bytes:
            return f.read(struct.unpack("<I", f.read(4))[0])

        ids, null = np.frombuffer(unpack(part()), "<i8"), np.frombuffer(unpack(part()), "u1")
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(unpack(part()), "<u4").astype(np.int64)
        self.zeros: list[int] = []
        self._packed: list[np.ndarray | None] = []
        self._ranks: list[np.ndarray | None] = []
        for _ in range(WIDTH):
            data = part()
            self.zeros.append(struct.unpack_from("<I", data)[0])
            if len(data) == 4:
                self._packed.append(None)
                self._ranks.append(None)
                continue
            size = struct.unpack_from("<I", data, 4)[0]
            self._ranks.append(np.frombuffer(unpack(data[8 : 8 + size]), "<u4"))
            self._packed.append(np.frombuffer(unpack(data[8 + size :]), np.uint8))

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a position."""
        packed, ranks = self._packed[level], self._ranks[level]
        if packed is None:
            return 0
        block, bit = divmod(at, STRIDE)
        begin = block * STRIDE // 8
        whole, rest = divmod(bit, 8)
        n = int(ranks[block - 1]) if block else 0
        n += int(np.bitwise_count(packed[begin : begin + whole]).sum())
        return n + ((int(packed[begin + whole]) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def _bit(self, level: int, at: int) -> int:
        packed = self._packed[level]
        return 0 if packed is None else packed[at >> 3] >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The token at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(WIDTH):
            ones = self._ones(level, at)
            bit = int(self._bit(level, at))
            token = token << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return token

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for level in range(WIDTH):
            a, b = self._ones(level, begin), self._ones(level, end)
            if token >> (WIDTH - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, token: int, at: int) -> int:
        """Occurrences of a token before a position."""
        begin, end = self._range(token, 0, at)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """The position of the ``nth`` (from 0) occurrence of a token."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= nth < end - begin:
            raise IndexError(nth)
        at = begin + nth
        for level in range(WIDTH - 1, -1, -1):
            one = token >> (WIDTH - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n - 1  # the position whose bit is the want-th of its kind
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def tokens(self) -> np.ndarray:
        """All tokens: the planes' stable partitions undone from the last to the first."""
        row = np.zeros(self.n, dtype=np.uint16)
        for level in range(WIDTH - 1, -1, -1):
            if self._packed[level] is None:
                continue
            one = np.unpackbits(self._packed[level], bitorder="little", count=self.n).view(bool)
            back = np.empty_like(row)
            back[np.flatnonzero(~one)] = row[: self.zeros[level]]
            back[np.flatnonzero(one)] = row[self.zeros[level] :] | np.uint16(1 << (WIDTH - 1 - level))
            row = back
        return row


_SHARDS = "part int, seq int, first_doc long, n_docs long, n_tokens long, shard binary"


def write_shards(docs: DataFrame, path: str, end_id: int | None = None, shard_tokens: int = SHARD_TOKENS, output: str | None = None) -> DataFrame:
    """Encode ``doc_id, text`` and write wavelet shards in ascending id order; returns the table that was written.

    It is written to ``output``, a new folder that all executors share, to be read with
    :func:`open_shards`, or staged where none is given.

    Its columns: ``part, seq`` (the order of shards), ``first_doc, n_docs, n_tokens, shard``.
    ``path`` is of a ``tokenizer.json`` with ids below 65536 that executors can read;
    ``end_id`` is put after each document. Null texts are empty, null ids come first,
    rows of one id stay next to each other in the order of their texts. A document
    is never split, so a shard is as long as its last document makes it. Ids are whole numbers; other text as an id fails the job. Other
    columns are not read. An empty table gives no shard.
    """
    python_batches(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], dtype="<u2").tobytes()

    def shards(batches):
        from pyspark import TaskContext

        encoder, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        data: list[bytes] = []

        def row():
            tokens = np.frombuffer(b"".join(data), "<u2")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_doc": pa.array([ids[0]], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "shard": pa.array([build(tokens, ids, lengths)], pa.binary())})

        held = 0
        for batch in batches:
            for doc, one in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, batch.column("text").to_pylist()), strict=True):
                one = one + end
                ids.append(doc)
                lengths.append(len(one) // 2)
                data.append(one)
                held += len(one) // 2
                if held >= shard_tokens:
                    yield row()
                    seq, held, ids, lengths, data = seq + 1, 0, [], [], []
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(shards, _SHARDS)
    if output is None:
        return stage(made, "wavelet", codec="none")
    made.write.option("compression", "none").parquet(output)
    return open_shards(docs.sparkSession, output)


def open_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards that :func:`write_shards` left in a folder."""
    return spark.read.schema(_SHARDS).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, seq, start``: tokens before each shard. Sums per part first, then within a part."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the shards alone."""
    starts = stage(shard_starts(shards).withColumnsRenamed({"part": "s_part", "seq": "s_seq"}), "wavelet-starts")
    placed = join_small(shards.select("part", "seq", "shard"), starts, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq"))).select("start", "shard")

    def decoded(batches):
        for batch in batches:
            for base, data in zip(batch.column("start").to_pylist(), batch.column("shard"), strict=True):
                shard = Shard(data.as_py())
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(begins + base, pa.int64()), "n_tokens": pa.array(shard.lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """``part, seq, n``: occurrences of one token in each shard, by rank on the planes."""

    def counted(batches):
        for batch in batches:
            n = [Shard(d.as_py()).count(token) for d in batch.column("shard")]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "seq": batch.column("seq"), "n": pa.array(n, pa.int64())})

    return shards.select("part", "seq", "shard").mapInArrow(counted, "part int, seq int, n long")
