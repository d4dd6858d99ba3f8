"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two sets with Jaccard similarity of at least t share a token among the first ``n - ceil(t * n) + 1`` tokens of each,
under any total order of tokens. Three orders are used here: by how common a token is, then by a permutation of the
hashes; tokens not known as common first, then by a second permutation; by a third permutation alone.

1. One pass writes of each document its set's size and 128-bit digest, and counts tokens: every task counts all of its
   tokens, some millions at a time, and sends on those that it saw twice or more. The KNOWN most frequent of the whole
   corpus are kept, whatever its size, in a table of fixed size; a wrong count changes the orders, which any serve.
   Equal sets become one node.
2. The prefix of the first order is sent out by token. Of the nodes that meet at a token, those pairs stay whose sizes
   and token histograms allow similarity t (both are lower bounds of the difference, so no pair is lost). A long list
   is searched breadth-first and gives one link for each node, not all pairs; a token whose list would be too long
   for one task is dealt out as pairs of blocks.
3. Connected candidates make classes. A class is verified in one group, or in pairs of blocks when it is large: a pair
   must share prefix tokens under every order before its exact intersection counts.
4. Components of the verified links give the result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, ragged, record_batch, released, runs, slices, small_or_plain
from .shingles import mix, shingle_sets

ORDERS = 3
#: Slots of the table of common tokens (2 ** SKETCH_BITS bytes), and the most tokens that it knows.
SKETCH_BITS = 24
KNOWN = 2_000_000
#: Tokens that a task counts at a time.
COUNTED = 4_000_000
#: A token of so many documents or more is dealt out in blocks of about so many, pair by pair, but no more than MOST_BLOCKS
#: blocks; a class in blocks of so many shingles.
HOT_LIST, MOST_BLOCKS = 20_000, 64
CLASS_BLOCK = 2_000_000
_SALTS = [np.uint64(0x632BE59BD9B4E019 * (2 * k + 1) % (1 << 64)) for k in range(ORDERS)]
#: Eighth powers of two that a count is told by, in the table.
_STEPS = 8


def _slots(tokens: np.ndarray, size: int) -> np.ndarray:
    """The slots of tokens in a table whose size is a power of two."""
    return (tokens >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and _STEPS more for each doubling; a byte holds counts up to 2 ** 31."""
    return np.minimum(255, 1 + np.floor(_STEPS * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _prefix_size(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1


def _prefix(tokens: np.ndarray, seen: np.ndarray, order: int, p: int) -> np.ndarray:
    """The first p tokens under an order; seen: the tokens' levels in the table."""
    key = mix(tokens ^ _SALTS[order]) >> np.uint64(8)
    if order == 0:
        key |= seen.astype(np.uint64) << np.uint64(56)
    elif order == 1:
        key |= (seen > 0).astype(np.uint64) << np.uint64(56)
    if p < len(key):
        return tokens[np.argpartition(key, p - 1)[:p]]
    return tokens


def _blocks(levels: np.ndarray, hot_list: int) -> np.ndarray:
    """Blocks that the lists of hot tokens with these levels are dealt out in."""
    return np.clip(np.ceil(2.0 ** ((levels.astype(float) - 1) / _STEPS) / hot_list), 2, MOST_BLOCKS).astype(np.int64)


def _per_bucket(t: Fraction) -> int:
    """Tokens a bucket of the histograms: with m a bucket, those of two unrelated sets differ by about 0.57 / sqrt(m) of their
    sizes, and that must be well over (1 - t) / (1 + t), or any two sets that share a token would be candidates."""
    return max(4, int((0.566 / (1.25 * float((1 - t) / (1 + t)))) ** 2)) if t < 1 else 1000


def _histogram(tokens: np.ndarray, per: int) -> np.ndarray:
    """Counts of tokens by hash, as many buckets as a power of two, at least 16 and n / per."""
    m = 16
    while m * per < len(tokens):
        m *= 2
    while True:
        h = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m)
        if h.max() < 256:
            return h.astype(np.uint8)
        m *= 2


def _survey(n: int, parts: int, counted: int):
    """Sizes and digests of the documents, and for each part of the tokens those that this task has seen more than once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def common(held):
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        tokens = tokens[1:][tokens[1:] == tokens[:-1]]  # of each token all but one
        start, end = runs(tokens)
        tokens, counts = tokens[start], (end - start + 1).astype(np.uint32)
        cut = np.searchsorted(_part(tokens, parts), np.arange(parts + 1))
        rows = [(i, tokens[x:y].tobytes(), counts[x:y].tobytes()) for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
        if rows:
            none = [None] * len(rows)
            yield record_batch(schema, none, none, none, none, *zip(*rows, strict=True))

    def run(batches):
        held, size = [], 0
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            d = [_digest(s) for s in sets]
            none = [None] * len(sets)
            yield record_batch(schema, batch.column(0), [len(s) for s in sets], [x[0] for x in d], [x[1] for x in d], none, none, none)
            held += sets
            size += sum(map(len, sets))
            if size > counted:
                yield from common(held)
                size = 0
        if size:
            yield from common(held)

    return run


def _part(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The part, by range, of sorted tokens."""
    return ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _most_common(limit: int):
    """Of each part of the tokens the most frequent ones, with their levels."""
    schema = pa.schema([("tokens", pa.binary()), ("levels", pa.binary())])

    def merged(held):
        tokens, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(tokens)
        start, _ = runs(tokens[order])
        return tokens[order][start], np.add.reduceat(counts[order], start)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, tokens, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(part, [])
                own.append((np.frombuffer(tokens, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)))
                if len(own) > 64:
                    own[:] = [merged(own)]
        for own in held.values():
            tokens, counts = merged(own)
            if len(tokens) > limit:
                kept = np.argpartition(-counts, limit - 1)[:limit]
                tokens, counts = tokens[kept], counts[kept]
            yield record_batch(schema, [tokens.tobytes()], [_level(counts).tobytes()])

    return run


def _table(surveyed: DataFrame, parts: int, bits: int, known: int) -> np.ndarray:
    """The level of every slot: that of the most frequent known token there, 0 where none is known."""
    rows = surveyed.where("part is not null").select("part", "tokens", "counts").repartition(parts, "part").mapInArrow(released(_most_common(max(1, known // parts))), "tokens binary, levels binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:  # at most `known` tokens of 9 bytes
        np.maximum.at(out, _slots(np.frombuffer(bytes(r.tokens), np.uint64), len(out)), np.frombuffer(bytes(r.levels), np.uint8))
    return out


def _postings(n: int, t: Fraction, per: int, sketch, hot_list: int):
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("hist", pa.binary())])

    def dealt(tokens, levels, d):
        """Instead of a hot token, one key for each pair of blocks that the node's block is in."""
        out = []
        for token, k in zip(tokens, _blocks(levels, hot_list).tolist(), strict=True):
            other = np.arange(k, dtype=np.uint64)
            own = np.uint64(d % k)
            out.append(mix(token ^ mix(np.minimum(other, own) * np.uint64(MOST_BLOCKS) + np.maximum(other, own) + np.uint64(1))))
        return np.concatenate(out)

    def run(batches):
        counts, hot_level = sketch.value, _level(np.array([hot_list]))[0]
        for batch in slices(batches):
            token, node, size, hist = [], [], [], []
            known: set[int] = set()
            for s in shingle_sets(batch.column(0).to_pylist(), n):
                if not len(s) or (d := _digest(s)[0]) in known:
                    continue
                known.add(d)
                seen = counts[_slots(s, len(counts))]
                p = _prefix(s, seen, 0, _prefix_size(len(s), t))
                levels = counts[_slots(p, len(counts))]
                hot = levels >= hot_level
                if hot.any():
                    p = np.concatenate((p[~hot], dealt(p[hot], levels[hot], d)))
                h = _histogram(s, per).tobytes()
                token.append(p.view(np.int64))
                node.append(np.full(len(p), d))
                size.append(np.full(len(p), len(s)))
                hist.extend([h] * len(p))
                if len(hist) > 100_000:
                    yield record_batch(schema, np.concatenate(token), np.concatenate(node), np.concatenate(size), hist)
                    token, node, size, hist = [], [], [], []
            if hist:
                yield record_batch(schema, np.concatenate(token), np.concatenate(node), np.concatenate(size), hist)

    return run


def _close(size_a, size_b, l1, t: Fraction) -> np.ndarray:
    """May sets of these sizes, whose histograms differ by l1, have similarity t? |x Δ y| <= (1 - t) / (1 + t) * (|x| + |y|)."""
    up, down = t.denominator - t.numerator, t.denominator + t.numerator
    return (t.denominator * np.minimum(size_a, size_b) >= t.numerator * np.maximum(size_a, size_b)) & (down * l1 <= up * (size_a + size_b))


def _folded(hists: list[bytes], m: int) -> np.ndarray:
    out = np.zeros((len(hists), m), np.int32)
    for i, h in enumerate(hists):
        out[i] = np.frombuffer(h, np.uint8).reshape(-1, m).sum(0)
    return out


def _meet(t: Fraction):
    """Candidate links between the nodes at each token of a partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def exact_l1(nodes, hist_of, a, b, l1):
        """Histograms of more than 16 buckets are compared in full, where the folded ones don't decide."""
        for i in range(len(a)):
            x, y = hist_of[a[i]], hist_of[b[i]]
            if len(x) > 16 and len(y) > 16:
                m = min(len(x), len(y))
                l1[i] = np.abs(x.reshape(-1, m).sum(0, dtype=np.int32) - y.reshape(-1, m).sum(0, dtype=np.int32)).sum()
        return l1

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        token, node, size = (table.column(c).to_numpy() for c in ("token", "node", "size"))
        order = np.lexsort((node, token))
        same = np.zeros(len(order), bool)
        same[1:] = (token[order][1:] == token[order][:-1]) & (node[order][1:] == node[order][:-1])
        order = order[~same]
        start, end = runs(token[order])
        keep = end - start > 1
        start, end = start[keep], end[keep]
        if not len(start):
            return
        used = order[ragged(start, end - start)]
        nodes, first, number = np.unique(node[used], return_index=True, return_inverse=True)
        column = table.column("hist")
        hist_of = [np.frombuffer(h, np.uint8) for h in column.take(pa.array(used[first])).to_pylist()]
        small = _folded([h.tobytes() for h in hist_of], 16)
        sizes = size[used[first]].astype(np.int64)
        counts = end - start
        offset = np.concatenate(([0], np.cumsum(counts)))[:-1]
        found: list[np.ndarray] = []

        def check(a, b):
            ok = t.denominator * np.minimum(sizes[a], sizes[b]) >= t.numerator * np.maximum(sizes[a], sizes[b])
            a, b = a[ok], b[ok]
            l1 = np.abs(small[a] - small[b]).sum(1)
            ok = _close(sizes[a], sizes[b], l1, t)
            return a[ok], b[ok], l1[ok]

        for length in np.unique(counts[counts <= 32]):
            at = offset[counts == length]
            i, j = np.triu_indices(length, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(at), step):
                part = number[at[k : k + step, None] + np.arange(length)]
                a, b, _ = check(part[:, i].ravel(), part[:, j].ravel())
                if len(a):
                    found.append(np.unique(a * len(nodes) + b))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = pairs // len(nodes), pairs % len(nodes)
        if len(a):
            l1 = exact_l1(nodes, hist_of, a, b, np.abs(small[a] - small[b]).sum(1))
            ok = _close(sizes[a], sizes[b], l1, t)
            yield record_batch(schema, nodes[a[ok]], nodes[b[ok]])
        done: set[bytes] = set()
        for k in np.flatnonzero(counts > 32):
            left = np.sort(number[offset[k] : offset[k] + counts[k]])
            if (mark := left.tobytes()) in done:
                continue
            done.add(mark)
            a_out, b_out, todo = [], [], []
            while len(left) or todo:
                if not todo:
                    todo, left = [left[0]], left[1:]
                x = todo.pop()
                if not len(left):
                    continue
                a, b, l1 = check(np.full(len(left), x), left)
                if len(a):
                    l1 = exact_l1(nodes, hist_of, a, b, l1)
                    near = b[_close(sizes[a], sizes[b], l1, t)]
                    left = np.setdiff1d(left, near, assume_unique=True)
                    todo.extend(near.tolist())
                    a_out.append(np.full(len(near), x))
                    b_out.append(near)
            if a_out:
                yield record_batch(schema, nodes[np.concatenate(a_out)], nodes[np.concatenate(b_out)])

    return run


def _verify(n: int, t: Fraction, sketch):
    """Exact links within each (class, i, j) of a partition sorted by these."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def group(rows: list[tuple]):
        by_digest: dict[tuple[int, int], tuple] = {}
        for (rep, d1, d2, mult, block, text), s in zip(rows, shingle_sets([r[5] for r in rows], n), strict=True):
            if _digest(s) == (d1, d2):
                by_digest[(d1, d2)] = (rep, mult, block, s)
        kept = list(by_digest.values())
        if not kept:
            return None
        reps = np.array([k[0] for k in kept], np.int64)
        mults = np.array([k[1] for k in kept], np.int64)
        blocks = np.array([k[2] for k in kept], np.int64)
        sizes = np.array([len(k[3]) for k in kept], np.int64)
        counts = sketch.value
        lists = [[k[3] for k in kept]] + [[_prefix(k[3], counts[_slots(k[3], len(counts))], o, _prefix_size(len(k[3]), t)) for k in kept] for o in range(ORDERS)]

        def index(sets):
            own = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            values, number = np.unique(flat, return_inverse=True)
            by = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[by], np.arange(len(values) + 1))
            return number, np.concatenate(([0], np.cumsum(own))), np.repeat(np.arange(len(sets)), own)[by], starts

        full, *prefixes = (index(x) for x in lists)

        def meets(idx, x):
            number, first, holders, starts = idx
            mine = number[first[x] : first[x + 1]]
            return np.bincount(holders[ragged(starts[mine], starts[mine + 1] - starts[mine])], minlength=len(kept))

        links = np.zeros(len(kept), np.int64)
        label = np.arange(len(kept))
        left, right = [], []
        both = blocks.min() != blocks.max()
        for x in range(len(kept)):
            may = (t.denominator * np.minimum(sizes, sizes[x]) >= t.numerator * np.maximum(sizes, sizes[x])) & (np.arange(len(kept)) > x)
            if both:
                may &= blocks != blocks[x]
            for idx in prefixes:
                if not may.any():
                    break
                may &= meets(idx, x) > 0
            ys = np.flatnonzero(may)
            if not len(ys):
                continue
            common = meets(full, x)[ys]
            ys = ys[t.denominator * common >= t.numerator * (sizes[ys] + sizes[x] - common)]
            if len(ys):
                links[x] += mults[ys].sum()
                links[ys] += mults[x]
                left.append(np.full(len(ys), x))
                right.append(ys)
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            while True:
                low = np.minimum(label[left], label[right])
                before = label.copy()
                np.minimum.at(label, left, low)
                np.minimum.at(label, right, low)
                label = label[label]
                if (label == before).all():
                    break
        return record_batch(schema, reps, reps[label], links)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != key:
                    if len(rows) > 1 and (out := group(rows)) is not None:
                        yield out
                    key, rows = (root, i, j), []
                rows.append(tuple(row))
        if len(rows) > 1 and (out := group(rows)) is not None:
            yield out

    return run


def jaccard_components(
    docs: DataFrame, *, n: int = 5, threshold: str | float = "0.8", id_col: str = "doc_id", text_col: str = "text", per_bucket: int | None = None,
    slot_bits: int = SKETCH_BITS, known: int = KNOWN, counted: int = COUNTED, hot_list: int = HOT_LIST, class_block: int = CLASS_BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs.

    ``threshold`` is taken as an exact decimal. Sets are of n-word shingles of the text with A-Z in lower case; a text of
    fewer words is one shingle. ``component_id`` is the smallest id that links reach; ``n_links`` counts the other rows
    that the row's set is similar to, its copies included. The other parameters bound tables, lists and groups; no value of
    them changes the result.

    * A null text, or one without words, has an empty set and is linked with nothing: its component is its own id.
    * A row with a null id has a null component and links with nothing.
    * Rows that repeat an id are one document: their components are one, and each row is returned.
    * A text of any length is taken as a whole; about 50 bytes a byte of it are held at once.
    * Other columns of docs are not read, whatever their names. An empty table gives an empty result.
    """
    t = Fraction(str(threshold))
    per_bucket = per_bucket or _per_bucket(t)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = min(4096, max(16, base.rdd.getNumPartitions() // 2))
    surveyed = checkpointed(base.mapInArrow(released(_survey(n, parts, counted)), "doc_id long, n_shingles long, d1 long, d2 long, part int, tokens binary, counts binary"))
    sketch = spark.sparkContext.broadcast(_table(surveyed, parts, slot_bits, known))
    rows = surveyed.where("part is null").select("doc_id", "n_shingles", "d1", "d2")
    nodes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("n_shingles").alias("n"))
    nodes = checkpointed(nodes)

    posted = base.where("doc_id is not null").select("text").mapInArrow(released(_postings(n, t, per_bucket, sketch, hot_list)), "token long, node long, size int, hist binary")
    dealt = posted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    candidates = dealt.mapInArrow(released(_meet(t)), "a long, b long").distinct()
    classes = connected_components(candidates)

    members = nodes.join(classes.withColumnRenamed("node", "d1"), "d1")
    extent = members.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("n_members")).where("n_members > 1").select("root", F.ceil(F.col("weight") / class_block).cast("int").alias("k"))
    members = checkpointed(members.join(extent, "root").select(F.col("rep").alias("doc_id"), "d1", "d2", "mult", "root", "k"))
    found = base.join(small_or_plain(members), "doc_id")
    block = F.pmod(F.xxhash64("d1", "d2"), F.col("k")).cast("int")
    cells = found.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "d1", "d2", "mult", "block", "text")
    cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = checkpointed(cells.mapInArrow(released(_verify(n, t, sketch)), "a long, b long, links long"))

    # Rows that repeat an id tie the sets of their texts together.
    repeated = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    ties = rows.join(repeated, "doc_id").join(nodes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = verified.select("a", "b").unionByName(ties).where("a <> b").distinct()
    roots = connected_components(edges)
    links = verified.groupBy("a").agg(F.sum("links").alias("links"))

    named = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("a", "rep"), "rep", "left")
    named = named.select("d1", "d2", "mult", F.coalesce("root", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(named, ["d1", "d2"], "left")
    lone = F.col("component").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(lone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(lone, F.lit(0).cast("long")).otherwise(F.col("links") + F.col("mult") - 1).alias("n_links"),
    )
