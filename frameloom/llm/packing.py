"""Packing of documents into sequences of bounded length: linear grouping, then best fit.

Documents become ids and are cut into pieces of at most a sequence's length; only longer documents are cut.
Lengths are small integers, so the whole packing problem is a histogram of at most ``capacity`` counts:
that, and nothing of the documents, reaches the driver. There

1. large lengths, in descending order, form groups of equal cardinality, and each counts as the longest of its group;
2. a few sizes are left: the configurations (what one sequence can hold of each) that cover their
   demand with the fewest sequences are found by a linear program whose columns come from a
   knapsack, and are used as often as the program says, rounded down;
3. groups stand for their documents again: runs of actual lengths go into the configurations' places, so
   every sequence's real gap is known, and what rounding left over is known too;
4. that rest and all small lengths, from long to short, go where they fit best, else into new sequences.

A few bounds of large lengths and numbers of groups are tried, and the plan with fewest sequences is taken. A plan is rows
(length, first rank, pieces, sequence, pieces a sequence, offset): of pieces of one length, those of certain ranks.
Spark ranks pieces within their length by counts of each task and length, without a sort or a shuffle of
pieces, and every task looks its pieces up in the plan. Time and size of a plan depend on the number of distinct lengths alone.

Defined cases: null texts are empty, an empty text is its end id alone; repeated rows are pieces of their own;
an empty table has no rows; very long texts are cut into pieces; kept columns whose names the results take go on with ``_in`` added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from struct import pack
from unicodedata import category

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameloom.llm.common import arrow_bounds, bounded, kept_names, stored

#: What is tried: (share, groups): lengths above a sequence's ``share``-th part are large, and form so many groups.
TRIALS = ((2, 128), (3, 96), (4, 64), (8, 40))
#: Chunks of text whose ids a worker remembers before it forgets all of them, and their longest.
MEMO = 1_000_000
MEMO_CHARS = 64
#: Visible characters that do not change under composition, and of which each has one lower-case letter.
LATIN = "".join(chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130)

#: Formats of so many ids.
FORMATS = [f"<{n}I" for n in range(MEMO_CHARS)]

_CODERS: dict[str, WordCoder] = {}


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


def _pre_tokens() -> re.Pattern:
    """The pattern of pre-tokens in lower-case text of ``LATIN`` characters: endings, runs of letters, single numbers, runs of marks."""
    letters, numbers = (re.escape("".join(c for c in LATIN if category(c)[0] == kind)) for kind in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")


class _Memo(dict):
    """The ids of chunks; what is not there is learned at the first use, and kept if it is short."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        out = self.learn(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = out
        return out


class WordCoder:
    """Ids of a ``tokenizers`` file that lower-cases and whose pre-tokens end at white space and between letters and marks.

    Chunks between blanks are encoded once and remembered. Those of Latin characters are cut into pre-tokens
    here, of which only the merges are asked for, where the file proves to be of that kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.latin = re.compile(f"[{re.escape(LATIN)}]+").fullmatch
        self.pre_tokens = _pre_tokens().findall
        self.memo = _Memo(self._learned)
        probes = ["a", "xyzzy", "plural", "\u00e9t\u00e9", "\u00fcber", "na\u00efve", "\u0161koda", "it's", "we'LL,'tis''s", "a1b23", "x\u00b2\u00bd", "(no).?!", "a_b-c\u00d7d", "<|endoftext|>"]
        self.by_merges = True
        self.by_merges = all(self._learned(w) == self._whole(w) for w in probes)
        self.memo.clear()

    def _whole(self, chunk: str) -> bytes:
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _merged(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.merges(word)])

    def _learned(self, chunk: str) -> bytes:
        if not (self.by_merges and self.latin(chunk)):
            return self._whole(chunk)
        key = chunk.lower()
        if key.isalpha():
            return self._merged(key) if key == chunk else self.memo[key]
        parts = self.pre_tokens(key)
        return self._merged(key) if len(parts) == 1 else b"".join(map(self.memo.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) >= MEMO:
            memo.clear()
        chunks = text.replace("\n", " ").split(" ")
        if not text.isascii():
            others = [c for c in set(chunks) if c not in memo and not (self.by_merges and self.latin(c)) and len(c) <= MEMO_CHARS]
            coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else []
            memo.update((chunk, _packed(c.ids)) for chunk, c in zip(others, coded, strict=True))
        return b"".join(map(memo.__getitem__, chunks))


def _packed(ids: list[int]) -> bytes:
    return pack(FORMATS[len(ids)], *ids) if len(ids) < len(FORMATS) else pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, text: str, keep: list[str], path: str, capacity: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """``keep`` with piece, start, length, ids_crc32 and, if asked for, the ids; and where each piece was made.

    ``_task`` and ``_nth`` (from zero, among the task's pieces of one length) name a piece; write the result before they are used.
    """
    import pyarrow as pa

    arrow_bounds(docs.sparkSession)
    kept = kept_names(keep, ["piece", "start", "length", "ids_crc32", "ids", "_task", "_nth", "_text"])
    source = docs.select(*(docs[c].alias(n) for c, n in zip(keep, kept, strict=True)), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np
        from pyspark import TaskContext

        if path not in _CODERS:
            _CODERS[path] = WordCoder(path)
        coder = _CODERS[path]
        task, seen, last = TaskContext.get().partitionId(), [0] * (capacity + 1), end.to_bytes(4, "little")
        for batch in batches:
            rows, cells, crcs, held = [], [], [], []
            for row, t in enumerate(batch.column(len(kept)).to_pylist()):
                coded = np.frombuffer(coder.encode(t or "") + last, dtype="<u4")
                for piece, start in enumerate(range(0, len(coded), capacity)):
                    part = coded[start : start + capacity]
                    rows.append(row)
                    cells.append((piece, start, len(part), seen[len(part)]))
                    seen[len(part)] += 1
                    crcs.append(crc32(part.tobytes()))
                    if ids:
                        held.append(part.astype(np.int32))
            taken = batch.select(range(len(kept))).take(pa.array(rows, pa.int64()))
            piece, start, length, nth = (np.array(c, dtype=np.int64) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 4
            columns = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            if ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            columns += [pa.array(np.full(len(rows), task)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=names)

    schema = source.schema[:-1].add("piece", T.IntegerType()).add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = (schema.add("ids", T.ArrayType(T.IntegerType())) if ids else schema).add("_task", "long").add("_nth", "long")
    names = schema.names
    return source.mapInArrow(run, schema)


@dataclass
class Class:
    """``count`` sequences alike: what they hold is (length, rank of the first sequence's first piece, pieces a sequence)."""

    count: int
    gap: int
    held: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, at: int) -> tuple[Class, Class]:
        """The first ``at`` sequences and the others."""
        return Class(at, self.gap, list(self.held)), Class(self.count - at, self.gap, [(s, first + at * q, q) for s, first, q in self.held])

    def put(self, length: int, first: int, each: int) -> Class:
        self.held.append((length, first, each))
        self.gap -= length * each
        return self


def grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Descending (length, count) cut into so many groups of as many pieces each; groups of one longest length are one.

    As few lengths as groups stay as they are.
    """
    if len(counts) <= groups:
        return [[c] for c in counts]
    total = sum(n for _, n in counts)
    most = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in counts:
        while n:
            if not room:
                room = most
                if not out or out[-1][0][0] != length:
                    out.append([])
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def best_knapsack(sizes: list[int], values, most: list[int], capacity: int):
    """(value, numbers of each size) of the most valuable sequence, at most ``most`` of each."""
    import numpy as np

    best, steps = np.zeros(capacity + 1), []
    for size, value, limit in zip(sizes, values, most, strict=True):
        limit = min(limit, capacity // size)
        taken = np.zeros(capacity + 1, dtype=np.int16)
        if value > 1e-12:
            base = best.copy()
            for k in range(1, limit + 1):
                more = base[: capacity + 1 - k * size] + k * value
                at = np.nonzero(more > best[k * size :] + 1e-12)[0] + k * size
                best[at], taken[at] = more[at - k * size], k
        steps.append(taken)
    room, numbers = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        numbers[i] = int(steps[i][room])
        room -= numbers[i] * sizes[i]
    return float(best[capacity]), numbers


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[list[int], float]]:
    """(numbers of each size, how often) of the linear program that covers ``demand`` with the fewest sequences."""
    import numpy as np

    if not sizes:
        return []
    b = np.array(demand, dtype=np.float64)
    basis = np.diag([float(min(capacity // s, n)) for s, n in zip(sizes, demand, strict=True)])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = np.maximum(inverse @ b, 0.0)
        prices = inverse.sum(axis=0)
        value, column = best_knapsack(sizes, prices, demand, capacity)
        if value <= 1 + 1e-7:
            break
        turn = inverse @ np.array(column, dtype=np.float64)
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(basis[:, j].astype(int).tolist(), float(use[j])) for j in range(len(sizes))]


class _Run:
    """A group's pieces as (length, rank, count), taken from the longest on."""

    def __init__(self, cells: list[tuple[int, int]], ranks: dict[int, int]) -> None:
        self.left = []
        for length, n in cells:
            self.left.append([length, ranks.get(length, 0), n])
            ranks[length] = ranks.get(length, 0) + n
        self.left.reverse()

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, rank, there = self.left[-1]
            use = min(n, there)
            out.append((length, rank, use))
            n -= use
            if use == there:
                self.left.pop()
            else:
                self.left[-1][1:] = [rank + use, there - use]
        return out


def _filled(config: list[int], times: int, runs: list[_Run], capacity: int) -> list[Class]:
    """The sequences of a configuration with actual lengths in its places: a class for each stretch of equal ones."""
    out = [Class(times, capacity)]
    for run, n in zip(runs, config, strict=True):
        for _ in range(n):
            cells, turned = run.take(times), []
            at = iter(cells)
            length, rank, there = next(at)
            for c in out:
                while c is not None:
                    rest = None
                    if c.count > there:
                        c, rest = c.split(there)
                    turned.append(c.put(length, rank, 1))
                    there, rank = there - c.count, rank + c.count
                    c = rest
                    if not there:
                        length, rank, there = next(at, (0, 0, 0))
            out = turned
    return out


def _best_fit(classes: list[Class], rest: list[tuple[int, int, int]], capacity: int) -> list[Class]:
    """``rest`` (length, rank, count), from long to short, into the smallest gaps that take them, else into new sequences."""
    by_gap: dict[int, list[Class]] = {}
    gaps: list[int] = []

    def add(c: Class) -> None:
        if c.gap not in by_gap:
            by_gap[c.gap] = []
            insort(gaps, c.gap)
        by_gap[c.gap].append(c)

    for c in classes:
        add(c)
    for length, rank, n in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                c = Class(n // each, capacity) if n >= each else Class(1, capacity)
            else:
                c = by_gap[gaps[at]].pop()
                if not by_gap[c.gap]:
                    del by_gap[c.gap], gaps[at]
            # the sequence with the smallest gap stays that one until it takes no more
            each = min(c.gap // length, n)
            full = min(c.count, n // each)
            if c.count > full:
                c, other = c.split(full)
                add(other)
            add(c.put(length, rank, each))
            rank, n = rank + full * each, n - full * each
    return [c for own in by_gap.values() for c in own]


@dataclass
class Plan:
    """Rows (length, first rank, pieces, sequence, pieces a sequence, offset), by length and rank, and the number of sequences."""

    rows: list[tuple[int, int, int, int, int, int]]
    sequences: int


def _laid_out(classes: list[Class]) -> Plan:
    rows, base = [], 0
    for c in classes:
        offset = 0
        for length, first, each in c.held:
            rows.append((length, first, c.count * each, base, each, offset))
            offset += length * each
        base += c.count
    return Plan(sorted(rows), base)


def planned(histogram: dict[int, int], capacity: int = 2048, trials: tuple[tuple[int, int], ...] = TRIALS) -> Plan:
    """The plan with fewest sequences of those tried, for so many pieces of each length."""
    counts = sorted(((s, n) for s, n in histogram.items() if n), reverse=True)
    least = -(-sum(s * n for s, n in counts) // capacity)
    best = None
    for share, groups in trials:
        plan = _laid_out(_classes(counts, capacity, share, groups))
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best or Plan([], 0)


def _classes(counts: list[tuple[int, int]], capacity: int, share: int, groups: int) -> list[Class]:
    """Descending (length, count) as sequences: configurations of grouped large lengths, then the rest by best fit."""
    out = [Class(n, capacity).put(s, 0, 1) for s, n in counts if s == capacity]
    cells = grouped([(s, n) for s, n in counts if capacity // share < s < capacity], groups)
    ranks: dict[int, int] = {}
    runs = [_Run(g, ranks) for g in cells]
    for config, often in configurations([g[0][0] for g in cells], [sum(n for _, n in g) for g in cells], capacity):
        # rounding of the arithmetic may not ask for more than there is
        times = min([int(often + 1e-6)] + [sum(x[2] for x in run.left) // n for run, n in zip(runs, config, strict=True) if n])
        out += _filled(config, times, runs, capacity) if times else []
    rest = [(length, rank, n) for run in runs for length, rank, n in run.left]
    return _best_fit(out, rest + [(s, 0, n) for s, n in counts if s <= capacity // share], capacity)


def ranked(cut: DataFrame) -> DataFrame:
    """Stored ``pieces`` with ``_rank``, from zero within each length, and without the columns it comes from."""
    held = stored(cut.groupBy(F.col("_task").alias("_t"), F.col("length").alias("_l")).agg(F.count("*").alias("_n")), "pack-counts")
    before = F.sum("_n").over(Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    shifts = stored(held.select("_t", "_l", F.coalesce(before, F.lit(0)).alias("_shift")), "pack-shifts")
    both = cut.join(bounded(shifts), (F.col("_task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    return both.withColumn("_rank", F.col("_shift") + F.col("_nth")).drop("_task", "_nth", "_t", "_l", "_shift")


def packed(docs: DataFrame, text: str, keep: list[str], path: str, capacity: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """``pieces`` of ``docs`` with sequence_id and offset: in as few sequences as the plan finds, without gaps from zero on."""
    import pyarrow as pa

    cut = stored(pieces(docs, text, keep, path, capacity, end, ids), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = planned(histogram, capacity)
    rows = ranked(cut)
    at = rows.columns.index("length"), rows.columns.index("_rank")
    schema = rows.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(plan.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array(shared.value, dtype=np.int64).reshape(-1, 6)
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in at)
            row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1] if len(batch) else table[:0]
            nth = rank - row[:, 1]
            columns = [c for i, c in enumerate(batch.columns) if i != at[1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + nth // np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + nth % np.maximum(row[:, 4], 1) * length)], names=names)

    return rows.mapInArrow(run, schema)


def sequences(laid: DataFrame) -> DataFrame:
    """sequence_id, ids and starts (offsets of its pieces) of each sequence of ``packed`` pieces that kept their ids."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: at most its capacity in ids
    return laid.groupBy("sequence_id").agg(own.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.offset").alias("starts"))
