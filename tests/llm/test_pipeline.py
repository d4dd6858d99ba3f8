"""Every stage of the pipeline against what it must do by hand, on documents with all kinds of edge rows and clashing columns."""

import collections
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farspread.llm import mixing, queries, rule_ensemble

from test_operators import WORDS, components, cut_by_hand

CLASHES = ("_gone", "gone", "_quality", "score", "held", "row", "n_chunks", "bytes_cut", "cut_spans", "mix_kept", "component_id", "_f_words", "_text", "_row", "key", "doc", "seqs", "length", "part")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with documents and labels, and one with empty tables."""
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    prose = docs.where("length(text) between 2000 and 6000").orderBy("doc_id").limit(3).collect()
    passage = " ".join(prose[0].text.split()[20:110])
    long = " ".join(f"{w}{i % 7}" for i, w in enumerate((prose[1].text + " " + prose[2].text).split() * 30))
    extra = [(9000, None, "en", "s"), (9001, "", None, None), (9002, " \n\t ", "en", "s"), (9003, "one", "en", "s"), (None, prose[0].text, "en", "s"), (None, None, None, None), (9004, prose[1].text, None, "s"),
             (9004, prose[1].text, None, "s"), (9005, prose[2].text.replace(" ", "  ", 3) + " end", "de", None), (9006, f"{prose[1].text[:900]} {passage} {prose[2].text[:800]}", "en", "s"), (9007, long, "en", "s"), (9008, long, "fr", "s")]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()] + extra
    full = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    full = full.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    out = []
    for name, d, m in (("full", full, labels), ("empty", full.limit(0), labels.limit(0))):
        folder = tmp_path_factory.mktemp(name)
        d.write.parquet(f"{folder}/documents.parquet")
        m.write.parquet(f"{folder}/labels.parquet")
        out.append(str(folder))
    return out


def kept_in(docs):
    return collections.Counter((r.doc_id, r.text) for r in docs.collect())


def root(f, low, high):
    """Where a rising function passes 0."""
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return high


def fitted_by_hand(rows):
    """Probabilities of rows (source, lang, topic, tokens) by raking in numpy."""
    keys = ("source", "lang", "topic")
    cells = collections.Counter()
    for *key, n in rows:
        cells[tuple(key)] += n
    names, tokens = [*cells], np.array([*cells.values()], float)
    fitted = tokens.copy()
    marginals = []
    for i, k in enumerate(keys):
        own = {c: [j for j, n in enumerate(names) if n[i] == c] for c in {n[i] for n in names}}
        want = np.array([queries.MIXTURE[k].get(c, queries.OTHERS) if tokens[j].sum() > 0 else 0.0 for c, j in own.items()])
        most = np.array([mixing.MOST_RATIO * tokens[j].sum() / tokens.sum() for j in own.values()])
        scale = root(lambda x: np.minimum(x * want / want.sum(), most).sum() - 1, 0.0, 1e6)
        marginals.append([*zip(own.values(), np.minimum(scale * want / want.sum(), most), strict=True)])
    for _ in range(400):
        for m in marginals:
            for j, share in m:
                fitted[j] *= tokens.sum() * share / fitted[j].sum() if fitted[j].sum() > 0 else 0.0
    ceiling = root(lambda c: mixing.SLACK * fitted.sum() - np.maximum(0, fitted - c * tokens).sum(), 0.0, 1e6)
    p = np.minimum(np.divide(fitted, tokens * ceiling, out=np.zeros_like(fitted), where=tokens > 0), 1)
    return dict(zip(names, p, strict=True))


def test_every_stage(spark, made):
    import public_tokenizers
    from tokenizers import Tokenizer

    at = made[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing to target weights", "best-fit packing"]

    names = [*rule_ensemble.features({k: F.lit(0.0) for k in rule_ensemble.statistics(F.lit(""))})]
    rules = rule_ensemble.fit_quality(docs, queries.training_labels(spark, at))
    rows = rule_ensemble.with_features(docs.select("doc_id", "text")).collect()
    scores = rules.score_rows(np.array([[r[f"_f_{f}"] for f in names] for r in rows]), names)
    want = collections.Counter((r.doc_id, r.text) for r, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.SCORE)
    docs = corpus_pipeline.quality(spark, docs, at).cache()
    assert docs.columns == columns and kept_in(docs) == want and 0 < want.total() < len(rows)

    data = [(r.doc_id, r.text) for r in docs.collect()]
    gone = {i for i, _, c in components(data, 5, Fraction("0.8")) if i is not None and i != c}
    want = collections.Counter((i, t) for i, t in data if i not in gone)
    docs = corpus_pipeline.near_duplicates(spark, docs, at).cache()
    assert docs.columns == columns and kept_in(docs) == want and gone

    data = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter((i, left) for (i, t), (left, n) in zip(data, cut_by_hand(data), strict=True) if not n or WORDS.search(left))
    docs = corpus_pipeline.substrings(spark, docs, at).cache()
    assert docs.columns == columns and kept_in(docs) == want and want != collections.Counter(data)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in docs.collect() for c in CLASHES)

    words = mixing.words_in(F.col("text"))
    rows = docs.select("doc_id", "text", "source", "lang", mixing.topic_of(F.col("text"), words).alias("topic"), words.alias("n")).collect()
    p = fitted_by_hand([(r.source, r.lang, r.topic, r.n) for r in rows])
    draw = lambda i: int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    want = collections.Counter((r.doc_id, r.text) for r in rows if draw(r.doc_id) < p[r.source, r.lang, r.topic])
    docs = corpus_pipeline.mixture(spark, docs, at).cache()
    assert docs.columns == columns and kept_in(docs) == want and 0 < want.total() < len(rows)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))] += 1
    packed = corpus_pipeline.packed(spark, docs, at).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    whole = corpus_pipeline.run(spark, at).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_an_empty_table(spark, made):
    docs = spark.read.parquet(f"{made[1]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, made[1])
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
    assert corpus_pipeline.run(spark, made[1]).count() == 0
