"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text. A chunk ends at a word end whose hash has its top bits clear, so that an
insertion moves boundaries only near itself. Where none comes for long, as in text without spaces, it ends at the next
character start that a rarer pattern of the hash picks. Chunks are compared by 128-bit digest. The first document (by id) that has
a chunk keeps it; elsewhere, and where a text repeats itself, runs of repeated chunks go if they are long enough.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import byte_slices, checkpointed, record_batch, released, slices
from .shingles import _BYTE, _SEPARATOR

#: A null id orders after every other.
LAST = (1 << 63) - 1
#: Rows of one chunk that are joined in one task, about; chunks that may be dealt out by parts, at most.
HOT, HOT_CHUNKS = 100_000, 200_000
#: A byte that UTF-8 never holds; it adds nothing to the hash.
_PAD = 0xFF
_GEAR = _BYTE.astype(np.uint32)
_GEAR[_PAD] = 0
#: Bytes that a hash depends on; each step shifts by _SHIFT bits, so that older bytes leave the 32.
_WINDOW, _SHIFT = 16, 2
#: Where no word end comes in time, one byte in 2 ** _FREE_BITS is a boundary if a character starts after it.
_FREE_BITS = 5


def _gear_hashes(buf: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < _WINDOW of gear[buf[i - j]] << (_SHIFT * j), by doubling the window."""
    h = _GEAR[buf]
    width = 1
    while width < _WINDOW:
        h[width:] += h[:-width] << np.uint32(_SHIFT * width)
        width *= 2
    return h


def chunk_bounds(texts: list[str | None], *, bits: int, least: int, most: int) -> list[tuple[bytes, list[int]]]:
    """Of each text its UTF-8 bytes and the ends of its chunks."""
    out: list[tuple[bytes, list[int]]] = []
    pad = bytes([_PAD]) * _WINDOW
    for i, j in byte_slices(texts):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]
        buf = np.frombuffer(pad + pad.join(parts) + pad, np.uint8)
        hashes = _gear_hashes(buf)
        cuts = np.flatnonzero(_SEPARATOR[buf] & (hashes >> np.uint32(32 - bits) == 0)) + 1
        free = np.flatnonzero(hashes[:-1] >> np.uint32(32 - _FREE_BITS) == 0) + 1
        free = free[buf[free] & 0xC0 != 0x80]
        at = _WINDOW
        for p in parts:
            loose = None
            own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, at + len(p))] - at
            ends, last = [], 0
            for c in [*own.tolist(), len(p)]:
                while c - last > most:  # no boundary for long: cut at a character that the hash picks, or else at the last that fits
                    if loose is None:
                        loose = (free[np.searchsorted(free, at) : np.searchsorted(free, at + len(p))] - at).tolist()
                    k = bisect_left(loose, last + least)
                    if k < len(loose) and loose[k] <= last + most:
                        last = loose[k]
                    else:
                        last += most
                        while p[last] & 0xC0 == 0x80:
                            last -= 1
                    ends.append(last)
                if c - last >= least:
                    ends.append(c)
                    last = c
            if last < len(p):
                if ends:
                    ends[-1] = len(p)
                else:
                    ends.append(len(p))
            out.append((p, ends))
            at += len(p) + _WINDOW
    return out


def _digests(data: bytes, ends: list[int]) -> list[int]:
    return [xxhash.xxh3_128_intdigest(data[a:b]) for a, b in zip([0, *ends], ends)]


def _chunks(shape: dict):
    """Rows (doc, key, h1, h2, seq) of each text's distinct chunks; seq is the first place, key tells texts of one id apart."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seq", pa.int32())])

    def run(batches):
        for batch in slices(batches):
            digests: list[int] = []
            seqs: list[int] = []
            held: list[int] = []
            for data, ends in chunk_bounds(batch.column(2).to_pylist(), **shape):
                own: dict[int, int] = {}
                for seq, d in enumerate(_digests(data, ends)):
                    own.setdefault(d, seq)
                held.append(len(own))
                digests.extend(own)
                seqs.extend(own.values())
            if digests:
                flat = np.frombuffer(b"".join(d.to_bytes(16, "big") for d in digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
                doc, key = (np.repeat(batch.column(i).to_numpy(), held) for i in (0, 1))
                yield record_batch(schema, doc, key, flat[:, 0], flat[:, 1], seqs)

    return run


def _rewrite(shape: dict, least_run: int):
    """(row, text) becomes (row, what is left of the text, counts, spans); seqs: chunks that an earlier document has."""

    def run(batches):
        for batch in slices(batches):
            texts, counts, spans = [], [], []
            original = batch.column("text").to_pylist()
            for text, elsewhere, (data, ends) in zip(original, batch.column("seqs").to_pylist(), chunk_bounds(original, **shape), strict=True):
                gone = set(elsewhere or ())
                seen: set[int] = set()
                flags = []
                for seq, d in enumerate(_digests(data, ends)):
                    flags.append(seq in gone or d in seen)
                    seen.add(d)
                cut, kept, at, k = [], [], 0, 0
                starts = [0, *ends[:-1]]
                chunks_cut = 0
                while k < len(flags):
                    if not flags[k]:
                        k += 1
                        continue
                    m = k
                    while m < len(flags) and flags[m]:
                        m += 1
                    if ends[m - 1] - starts[k] >= least_run or (k == 0 and m == len(flags)):
                        cut.append((starts[k], ends[m - 1]))
                        chunks_cut += m - k
                    k = m
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                texts.append(text if not cut else b"".join(kept).decode("utf-8", "surrogatepass"))
                counts.append((len(ends), chunks_cut, sum(b - a for a, b in cut)))
                spans.append([x for span in cut for x in span])
            added = [pa.array(texts, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *added], names=["row", "text", "n_chunks", "n_repeated_chunks", "bytes_cut", "cut_spans"])

    return run


def dedup_substrings(
    docs: DataFrame, *, bits: int = 2, least: int = 16, most: int = 512, least_run: int = 96, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the text less its repeated chunks, and n_chunks, n_repeated_chunks, bytes_cut, cut_spans.

    ``bits`` sets how rare boundaries are (one word end in 2 ** bits), ``least`` and ``most`` the bytes of a chunk, and
    ``least_run`` the bytes that adjoining repeated chunks must span to be cut (or else the whole text).
    ``n_repeated_chunks`` counts the chunks that were cut; a repeated one in a shorter run stays and doesn't count.
    ``cut_spans`` lists the starts and ends of what went, in bytes of the UTF-8 text. A chunk that more than ``hot`` rows
    have is joined in several parts.

    * A null text stays null and an empty one empty; both have no chunk.
    * A null id orders after all others. Rows that repeat an id are one document, none of which repeats the other, but
      each is cut by its own text. Rows without an id are one document likewise.
    * Equal texts under several ids: the smallest id keeps its text, of the others all goes and '' stays.
    * A text of any length is chunked as a whole; its bytes and hashes, about 12 bytes a byte of text, are held at once.
    * All columns of docs are kept; the five that are added replace those of the same name. Empty in, empty out.
    """
    shape = {"bits": bits, "least": least, "most": most}
    added = ["n_chunks", "n_repeated_chunks", "bytes_cut", "cut_spans"]
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc")
    text = F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(F.lit("key"), text, F.length(text)).alias("key")
    chunks = docs.select(doc, key, text.alias("text")).mapInArrow(released(_chunks(shape)), "doc long, key long, h1 long, h2 long, seq int")
    firsts = chunks.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.where("first <> last").select("h1", "h2", "first", "n"))
    # A chunk with many rows is dealt by document; few chunks can be so common, so their digests are broadcast.
    limit = max(hot, (firsts.agg(F.sum("n")).first()[0] or 0) // HOT_CHUNKS)
    common = firsts.where(F.col("n") > limit).select("h1", "h2", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    part = F.lit(0)
    if common.limit(1).count():
        chunks = chunks.join(F.broadcast(common), ["h1", "h2"], "left")  # at most HOT_CHUNKS rows
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "key"), F.col("parts"))).cast("int")
        last_part = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit).cast("int") - 1).otherwise(0)
        firsts = firsts.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), last_part)).alias("part"))
    else:
        firsts = firsts.select("h1", "h2", "first", F.lit(0).alias("part"))
    repeated = chunks.withColumn("part", part).join(firsts, ["h1", "h2", "part"]).where("doc <> first")
    repeated = repeated.groupBy("doc", "key").agg(F.collect_set("seq").alias("seqs"))
    others = [c for c in docs.columns if c != text_col]  # the text travels once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"), doc, key)
    rows = rows.join(repeated, ["doc", "key"], "left").select("row", "text", "seqs")
    kind = StructType([StructField("row", rows.schema["row"].dataType), StructField("text", StringType())])
    kind = StructType([*kind, *(StructField(c, LongType()) for c in added[:3]), StructField(added[3], ArrayType(LongType()))])
    out = rows.mapInArrow(released(_rewrite(shape, least_run)), kind)
    kept = [c for c in docs.columns if c not in added]
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in kept], *added)
