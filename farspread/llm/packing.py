"""Packing of tokenised documents into fixed-length sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity`` counts says all that a packing
needs. The plan is made from it on the driver and its size doesn't depend on the number of documents:

1. Large lengths, in falling order, are cut into groups of equal cardinality and rounded up to the group's largest.
2. Over these few sizes the configuration programme is solved by column generation (a knapsack prices new columns) and
   rounded down.
3. Actual documents take the places. A place takes the longest one that is left and fits, counting the room that rounding
   left in the places before it; a run of sequences whose places hold equal lengths stays one row of the plan.
4. What is left over, and then all small lengths, go by best fit into the tightest run that has room.

A document's rank among those of its length, computed per (length, salt), then leads to its sequence.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, record_batch, released, slices, small_or_plain

END_ID = 2
#: Entries of each of the two generations of a worker's memo of word encodings.
MEMO = 100_000
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 256
#: Characters of a text that are cut into words at once.
SEGMENT = 1_000_000
_GAP = re.compile(r"(?<=\S)\s")
#: Rows of one (length, salt) that are ranked together, about.
RANKED = 100_000


def _little_endian(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _below_65536(pattern: str):
    """findall of a word pattern for texts below U+10000: its character classes are spelt as ranges, which the standard
    module matches faster than properties. None for a pattern with other escapes."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x10000)]
    for escape in (r"\p{L}", r"\p{N}", r"\s"):
        member = regex.compile(escape).match
        inside = [c for c in points if member(chr(c))]
        breaks = [i for i in range(1, len(inside)) if inside[i] != inside[i - 1] + 1]
        spans = zip([0, *breaks], [*breaks, len(inside)], strict=True)
        ranges = "".join(rf"\u{inside[a]:04x}-\u{inside[b - 1]:04x}" for a, b in spans)
        negated = escape[0] + escape[1].upper() + escape[2:]
        # in a class the ranges alone, outside of one a class of them
        parts = re.split(r"(\[[^]]*\])", pattern)
        pattern = "".join(p.replace(escape, ranges) if p.startswith("[") else p.replace(escape, f"[{ranges}]").replace(negated, f"[^{ranges}]") for p in parts)
    return None if re.search(r"\\(?!u[0-9a-f]{4})", pattern) else re.compile(pattern).findall


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE files write for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, by a byte-level BPE file of the tokenizers library.

    The file's own pre-tokeniser cuts a text into words that are encoded one by one, so the encoding of a word is kept.
    The memo has two generations: a full one becomes the old one, and words of the old one that come again move over.
    A new word goes straight to the file's model, in the letters that stand for its bytes.
    """

    _of: dict[str, _Encoder] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.find, self.memo = Tokenizer.from_file(path), regex.compile(pattern).findall, {}
        self.find_low, self.high = _below_65536(pattern), re.compile("[\U00010000-\U0010ffff]").search
        self.old: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    @classmethod
    def get(cls, path: str, pattern: str) -> _Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path, pattern)
        return cls._of[path]

    def word(self, word: str) -> bytes:
        return _little_endian([t.id for t in self.model(word.encode("utf-8").decode("latin-1").translate(self.letters))])

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.part(text[a:b]) for a, b in _segments(text))

    def part(self, text: str) -> bytes:
        words = self.find_low(text) if self.find_low and not self.high(text) else self.find(text)
        memo, old = self.memo, self.old
        parts = list(map(memo.get, words))
        at = -1
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            w = words[at]
            if (e := memo.get(w)) is None:
                if (e := old.get(w)) is None:
                    e = self.word(w)
                memo[w] = e
            parts[at] = e
        if len(memo) > MEMO:
            self.old, self.memo = memo, {}
        return b"".join(parts)


def _segments(text: str):
    """Ranges of about SEGMENT characters. A word never goes over a white space that follows another character, so a text
    may be cut there; one without such a place isn't cut."""
    start = 0
    while len(text) - start > SEGMENT and (found := _GAP.search(text, start + SEGMENT)):
        yield start, found.start()
        start = found.start()
    yield start, len(text)


def _pieces(path: str | None, pattern: str | None, capacity: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        encoder = _Encoder.get(path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (encoder.encode(text) if text else b"") + end
                n = len(data) // 4
                at = 0
                for piece in range(-(-n // capacity)):
                    to = min(n, at + (n % capacity or capacity if piece == 0 else capacity))
                    part = data[4 * at : 4 * to]
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
                    at = to
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))

    return run


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits."""
    best, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(values > 1e-12):
        s = int(sizes[i])
        for _ in range(capacity // s):
            with_it = best[:-s] + values[i]
            better = with_it > best[s:] + 1e-12
            if not better.any():
                break
            steps.append((i, s, better))
            best[s:] = np.where(better, with_it, best[s:])
    c, out = capacity, np.zeros(len(sizes))
    for i, s, better in reversed(steps):
        if c >= s and better[c - s]:
            out[i] += 1
            c -= s
    return float(out @ values), out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often to use each, rounded down, from the programme that covers counts with fewest bins."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = counts / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        if not (change > 1e-10).any():
            break
        ratio = np.where(change > 1e-10, amount / np.where(change > 1e-10, change, 1), np.inf)
        leave = int(ratio.argmin())
        step = max(ratio[leave], 0.0)
        amount = np.maximum(amount - step * change, 0)
        amount[leave] = step
        basis[:, leave] = column
    return [(basis[:, j].astype(np.int64), int(amount[j] + 1e-9)) for j in range(k) if amount[j] + 1e-9 >= 1]


def packing_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): item ``rank`` of ``length`` goes to sequence ``first sequence + rank - first rank``."""
    small = capacity // 4 if small is None else small
    plan: list[tuple[int, int, int, int, int]] = []
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    taken = np.zeros(capacity + 1, np.int64)
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(n: int, run: int, first: int, offset: int) -> None:
        plan.append((n, int(taken[n]), int(taken[n]) + run, first, offset))
        taken[n] += run
        left[n] -= run

    if full := int(left[capacity]):
        put(capacity, full, 0, 0)
        sequences = full
    # 1. groups of equal cardinality: of each its largest length; groups that agree in it are one size
    large = [(n, int(left[n])) for n in range(capacity - 1, small, -1) if left[n]]
    total = sum(c for _, c in large)
    k = min(groups, total)
    rounded: dict[int, int] = {}
    before, group, size = 0, -1, 0
    for n, c in large:
        end = before + c
        while before < end:
            if before * k // total != group:
                group, size = before * k // total, n
            step = min(end, -(-total * (group + 1) // k)) - before
            rounded[size] = rounded.get(size, 0) + step
            before += step
    if rounded:
        # 2. few-size configurations
        sizes = np.array(sorted(rounded, reverse=True))
        for config, times in configurations(sizes, np.array([rounded[n] for n in sizes.tolist()], float), capacity):
            places = np.repeat(sizes, config).tolist()
            while times:
                # 3. documents in the places: each takes the longest that the places after it leave room for
                room, used, spare = capacity, {}, left.copy()
                for place in range(len(places)):
                    most = room - sum(places[place + 1 :])
                    fits = np.flatnonzero(spare[small + 1 : most + 1])
                    if not len(fits):
                        break
                    n = small + 1 + int(fits[-1])
                    used[n] = used.get(n, 0) + 1
                    spare[n] -= 1
                    room -= n
                if not used:
                    break
                run = min(times, *(int(left[n]) // c for n, c in used.items()))
                offset = 0
                for n, c in used.items():
                    for _ in range(c):
                        put(n, run, sequences, offset)
                        offset += n
                free[room].append((sequences, run))
                sequences += run
                times -= run
    # 4. best fit
    rest = [(n, int(taken[n]), int(taken[n] + left[n])) for n in range(capacity - 1, 0, -1) if left[n]]
    rooms = sorted(s for s in free if s > 0)
    for n, a, b in rest:
        while a < b:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                bins = -(-(b - a) // (capacity // n))
                free[capacity] = [(sequences, bins)]
                sequences += bins
                rooms.append(capacity)
            room = rooms[i]
            first, bins = free[room].pop()
            if not free[room]:
                rooms.pop(i)
            each = min(room // n, b - a)
            used_bins = min(bins, (b - a) // each)
            for layer in range(each):
                plan.append((n, a, a + used_bins, first, capacity - room + layer * n))
                a += used_bins
            for r, run in ((room - each * n, (first, used_bins)), (room, (first + used_bins, bins - used_bins))):
                if r and run[1]:
                    free[r].append(run)
                    if len(free[r]) == 1:
                        bisect.insort(rooms, r)
    return plan


def pack(docs: DataFrame, *, capacity: int = 1024, tokenizer: str | None = None, pattern: str | None = None, groups: int = GROUPS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every row of docs.

    ``tokenizer`` and ``pattern`` are a byte-level BPE file and its word pattern, else the public 50k one's.

    * A null or empty text is the end id alone, a piece of length 1.
    * A document over the capacity is cut into full pieces; only its first piece may be shorter.
    * A null id is kept as null; rows that repeat an id, or are equal, are packed one by one.
    * A text of any length is encoded as a whole, by parts of about SEGMENT characters; its ids are held at once.
    * Other columns of docs are not read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = base.mapInArrow(released(_pieces(tokenizer, pattern, capacity, with_ids)), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    pieces = checkpointed(pieces)
    # The partition is part of the salt, so that many equal rows aren't ranked in one group; the checkpoint fixes it.
    salts = max(16, pieces.count() // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.spark_partition_id()), F.lit(salts)).cast("int"))
    counts = checkpointed(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity, groups)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(within) - 1)
    ranked = ranked.join(small_or_plain(bases), (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s"))).withColumn("rank", F.col("base") + F.col("rn"))
    places = spark.createDataFrame(plan, "_n long, first long, end long, sequence long, offset long") if plan else spark.createDataFrame([], "_n long, first long, end long, sequence long, offset long")
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * with_ids)
