"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every merge rank owns a bucket of linked-list positions. A bitmap of two levels marks
the buckets that hold entries: words of about the square root of the number of ranks
in bits, and above them one word that marks those that are not zero. Find-first-set on
the top word, then on the word it names, gives the lowest rank in two steps,
however many entries are queued. Entries are never removed when
a neighbour merges: a popped entry whose position has died or whose pair has since
changed rank is stale and skipped. A pre-token of n bytes so takes O(n) queue
operations, which is what very long pre-tokens need.

Nulls and empty texts encode to no ids. Rows repeat as they come; columns that are
not asked for are never read; kept columns whose names the results take go on under the
name with ``_in`` added.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameloom.llm.common import arrow_bounds, kept_names

#: Pre-tokens remembered by a worker before it forgets all of them: bounds its memory.
MEMO = 1_000_000
#: Longer pre-tokens are not remembered.
MEMO_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a ``.tiktoken`` file: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BytePairCoder:
    """Encoder and decoder over a table of ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        # \s must mean Unicode's White_Space, as in the engine the ranks were made for
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.shift = (max(ranks.values(), default=0).bit_length() + 1) // 2
        self.low = [0] * (1 << self.shift)
        self.pairs = [-1] * 65536  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, longest, low, shift, get = len(piece), self.longest, self.low, self.shift, ranks.get
        mask, top = (1 << shift) - 1, 0
        buckets: dict[int, list[int]] = {}
        after = list(range(1, n + 1))  # where the token at a position ends, which is where the next begins
        before = list(range(-1, n - 1))
        pair = [self.pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # the rank a position is queued under
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                if (bucket := buckets.get(rank)) is not None:
                    bucket.append(i)
                else:
                    buckets[rank] = [i]
                    top |= 1 << (word := rank >> shift)
                    low[word] |= 1 << (rank & mask)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << shift | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)  # the leftmost first
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = pair[i] = -1
            left = before[i]
            found = []
            if end < n:
                before[end] = i
                if (stop := after[end]) - i <= longest and (rank := get(piece[i:stop])) is not None:
                    pair[i] = rank
                    found.append((rank, i))
            if left >= 0:
                pair[left] = -1
                if end - left <= longest and (rank := get(piece[left:end])) is not None:
                    pair[left] = rank
                    found.append((rank, left))
            for rank, at in found:
                if (bucket := buckets.get(rank)) is not None:
                    heappush(bucket, at)
                else:
                    buckets[rank] = [at]
                    top |= 1 << (word := rank >> shift)
                    low[word] |= 1 << (rank & mask)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class _Memo(dict):
    """Pre-token to packed ids, filled on demand."""

    def __init__(self, coder: BytePairCoder) -> None:
        self.coder = coder

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        packed = b"".join(i.to_bytes(4, "little") for i in self.coder.merge(piece))
        if len(piece) <= MEMO_BYTES:
            self[token] = packed
        return packed


#: Coders of this Python worker by table and pattern, kept from task to task.
_CODERS: dict[str, BytePairCoder] = {}


def _coder(key: str, ranks: dict[bytes, int], pattern: str) -> BytePairCoder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairCoder(ranks, pattern)
    return _CODERS[key]


def encoded(docs: DataFrame, text: str, keep: list[str], ranks: dict[bytes, int], pattern: str, ids: bool = True) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids.

    One pass without a shuffle: tasks hold a batch of texts and a bounded memo.
    """
    import pyarrow as pa

    arrow_bounds(docs.sparkSession)
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    kept = kept_names(keep, [*own, "_text"])
    source = docs.select(*(docs[c].alias(n) for c, n in zip(keep, kept, strict=True)), docs[text].alias("_text"))
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = _coder(key, ranks, pattern)
        for batch in batches:
            packed = [coder.encode(t) for t in batch.column(len(keep)).to_pylist()]
            cols = [batch.column(i) for i in range(len(keep))]
            cols.append(pa.array([len(p) // 4 for p in packed], pa.int64()))
            cols.append(pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()))
            cols.append(pa.array([hashlib.sha256(coder.decode(p)).hexdigest() for p in packed], pa.string()))
            if ids:
                cols.append(pa.array([np.frombuffer(p, dtype="<i4") for p in packed], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *own])

    schema = source.schema[:-1]
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *((("token_ids", T.ArrayType(T.IntegerType())),) if ids else ())):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def decoded(tokens: DataFrame, ids: str, keep: list[str], ranks: dict[bytes, int]) -> DataFrame:
    """Columns ``keep`` with ``text``: the bytes of the ids, read as UTF-8."""
    import pyarrow as pa

    arrow_bounds(tokens.sparkSession)
    kept = kept_names(keep, ["text", "_ids"])
    source = tokens.select(*(tokens[c].alias(n) for c, n in zip(keep, kept, strict=True)), tokens[ids].alias("_ids"))
    table = {rank: token for token, rank in ranks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, row or ())).decode("utf-8", "replace") for row in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*kept, "text"])

    return source.mapInArrow(run, source.schema[:-1].add("text", "string"))
