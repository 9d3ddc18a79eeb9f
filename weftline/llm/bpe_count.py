"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Of a piece of text the adjacent pair of the lowest rank is merged again and again;
the count is the number of first symbols less the number of merges, and no token
ids are made. Counts of pieces that recur are kept per worker within a bound.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_arrow, python_batches, without

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept per worker, and the longest that is kept.
KEPT_PIECES, KEPT_LENGTH = 400_000, 48
_DOUBLE_SPACE = re.compile(r"\s\s")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's merges."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeCounter:
    """Counts tokens as the library does with the merges and added tokens of a ``tokenizer.json`` file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec.get("normalizer") or any(spec["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("only files of a byte-level pre-tokenizer without a normalizer are counted")
        self.symbols = byte_symbols()
        self.split = regex.compile(PATTERN).findall
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.marks = tuple(added)
        self.kept: dict[str, int] = {}

    def merged_length(self, data: bytes) -> int:
        """Symbols left of ``data`` after all merges."""
        n = len(data)
        if n < 2:
            return n
        ranks = self.ranks
        symbol: list[str | None] = [self.symbols[b] for b in data]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] is None or j < 0 or ranks.get((symbol[i], symbol[j])) != rank:
                continue  # one of the two has been merged since
            symbol[i] += symbol[j]
            symbol[j] = None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def piece(self, text: str) -> int:
        """Tokens of a text that the pre-tokenizer splits by itself."""
        kept = self.kept
        found = kept.get(text)
        if found is None:
            found = sum(self.merged_length(p.encode("utf-8", "replace")) for p in self.split(text))
            if len(text) <= KEPT_LENGTH:
                if len(kept) >= KEPT_PIECES:
                    kept.clear()
                kept[text] = found
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens.

        A blank between two other characters always begins a pre-token, so texts
        without double white space are cut there and each piece is looked up.
        """
        if not text:
            return 0
        if _DOUBLE_SPACE.search(text):
            return sum(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        get, piece = self.kept.get, self.piece
        total = self.piece(first) if first else 0
        for word in rest:
            word = " " + word
            found = get(word)
            total += piece(word) if found is None else found
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each added token in it counts one."""
        if self.added is None or not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    """The counter of a worker process; what it keeps serves later tasks too."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    ``path`` is of a ``tokenizer.json`` file that executors can read. Null and
    empty texts count 0; repeated rows count alike; own columns of these names are
    replaced. No shuffle, and a batch at a time in memory.
    """
    python_batches(docs.sparkSession)
    docs = without(docs, "n_bytes", "n_tokens")

    def counted(batches):
        counter = merge_counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield append_arrow(batch, n_bytes=pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), n_tokens=pa.array([counter.count(t) for t in texts], pa.int64()))

    return docs.mapInArrow(counted, T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
