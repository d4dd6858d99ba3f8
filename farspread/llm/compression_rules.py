"""Quality rules over words and lines, and compression bands.

A zstandard ratio (bytes / compressed bytes) of the whole text and of fixed chunks says how repetitive a text is. Each
ratio must lie within limits for its length, as short texts compress less. Repetitive text lies above the band,
incompressible text (random strings, base64) below it. Hex compresses about as prose of its length does; it and other
encoded text show in how evenly they use their bytes, at every length.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, record_batch, released, slices
from .shingles import mix, word_hashes

#: Bytes of the text from which on a band holds, its lowest and its highest ratio: about halfway from random letters and
#: digits to clean prose, and from clean prose to prose with 30 % of its words in one repeated sentence, at sf0.1.
BANDS = (
    (0, 0.0, 1.75), (256, 1.23, 1.78), (362, 1.28, 1.86), (512, 1.33, 1.94), (724, 1.42, 2.08), (1024, 1.5, 2.23), (1448, 1.56, 2.34), (2048, 1.63, 2.45),
    (2896, 1.66, 2.58), (4096, 1.73, 2.67), (8192, 1.79, 2.79), (16384, 1.86, 2.89), (32768, 1.88, 3.03), (65536, 1.95, 3.2),
)
#: Bytes of a chunk, its lowest and highest ratio (set likewise), and the greatest share of chunks beyond them.
CHUNK = (2048, 1.65, 2.42, 0.34)
#: Greatest byte entropy over that of an even use of the same bytes; prose has up to 0.90, encoded text 0.94 and more.
EVENNESS = 0.92
_FACTORS = mix(np.arange(301, 304, dtype=np.uint64)) | np.uint64(1)
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def _repeated_words(texts: list[str]) -> tuple[list[int], list[int]]:
    """Of each text its words, and those of them in three-word windows (by 64-bit hash) that it has more than once."""
    h, first = word_hashes(texts, lower=False)
    n = np.diff(first)
    text = np.repeat(np.arange(len(texts)), n)
    marks = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        window = mix(h[:-2] * _FACTORS[0] + h[1:-1] * _FACTORS[1] + h[2:] * _FACTORS[2])
        at = np.flatnonzero(text[:-2] == text[2:])
        order = np.lexsort((window[at], text[at]))
        at = at[order]
        same = (window[at][1:] == window[at][:-1]) & (text[at][1:] == text[at][:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] = same
        twice[:-1] |= same
        np.add.at(marks, at[twice], 1)
        np.add.at(marks, at[twice] + 3, -1)
    covered = np.cumsum(marks)[:-1] > 0
    return n.tolist(), np.bincount(text[covered], minlength=len(texts)).tolist()


def base_counts(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Of each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = []
    for text, words, repeated in zip(texts, *_repeated_words(texts), strict=True):
        lines, repeated_lines = set(), 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in lines:
                    repeated_lines += 1
                elif line.strip(_SPACES):
                    lines.add(line)
        chars = len(text) - sum(text.count(c) for c in _SPACES)
        out.append((words, chars, sum(text.count(c) for c in _SYMBOLS), repeated_lines, repeated))
    return out


def compression(text: str, pack: zstandard.ZstdCompressor, size: int) -> tuple[int, float, list[float]]:
    """Bytes, the whole ratio, and the ratios of the chunks of that size of a longer text; the last one ends at its end."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0, 0.0, []
    ratio = len(data) / len(pack.compress(data))
    starts = [*range(0, len(data) - size, size), len(data) - size] if len(data) > size else []
    return len(data), ratio, [size / len(pack.compress(data[i : i + size])) for i in starts]


def evenness(data: bytes) -> float:
    """Entropy of the bytes over the greatest that their number of distinct values allows; 0 for fewer than two values."""
    counts = np.bincount(np.frombuffer(data, np.uint8))
    share = counts[counts > 0] / max(len(data), 1)
    return float(-(share * np.log2(share)).sum() / np.log2(len(share))) if len(share) > 1 else 0.0


def _judge(bands, chunk, most_even: float, level: int, least_words: int, most_repeated: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
         ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_chunks_outside", pa.int64())]
    )
    size, low, high, share = chunk
    edges = [b[0] for b in bands]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches):
            rows = []
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            counts = [c for i, j in byte_slices(texts) for c in base_counts(texts[i:j])]
            for doc_id, text, (n, chars, symbols, lines, repeated) in zip(ids, texts, counts, strict=True):
                failed = n < least_words or 100 * repeated > most_repeated * n
                length, ratio, chunks = compression(text, pack, size)
                _, least, most = bands[bisect_right(edges, length) - 1]
                outside = sum(not low <= r <= high for r in chunks)
                rows.append((doc_id, n, chars, symbols, lines, repeated, failed, not failed and least <= ratio <= most and evenness(text.encode("utf-8", "surrogatepass")) <= most_even and outside <= share * len(chunks), ratio, len(chunks), outside))
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))

    return run


def compression_rules(docs: DataFrame, *, bands=BANDS, chunk=CHUNK, most_even: float = EVENNESS, level: int = 3, least_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, ratio, n_chunks, n_chunks_outside.

    ``base_failed`` where a text has fewer than ``least_words`` words, or more than ``most_repeated`` percent of them lie
    in three-word windows that the text has twice. ``kept`` needs the whole ratio to be in its length's band, bytes
    used no more evenly than ``most_even``, and no more than the given share of chunks out of the chunk limits. A text
    longer than a chunk is cut into chunks from its start; what remains is judged with the bytes before it, as a full chunk.

    * A null or empty text has no word: zeros, base_failed, not kept.
    * A null id is kept as null; rows that repeat an id are judged one by one.
    * A text of any length is judged as a whole; about 60 bytes a word and its distinct lines are held at once.
    * Other columns of docs are not read, whatever their names. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(released(_judge(bands, chunk, most_even, level, least_words, most_repeated)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long")
