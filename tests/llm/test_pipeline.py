"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import numpy as np

from tarn.llm import language, sentencepieces, shingles, simhash
from tarn.llm.shared import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "pieces"]
    ids, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[-1]) < docs.count()
    prints = simhash.near_duplicates(now)
    assert prints.filter("component_id <> doc_id").isEmpty()
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == ids[-1]
    pieces, texts = sentencepieces.Pieces.load(corpus_pipeline.PIECES), {r["doc_id"]: r["text"] for r in now.collect()}
    assert all(pieces.decode(r["ids"]) == texts[r["doc_id"]] and r["n_ids"] == len(r["ids"]) for r in last)


def test_documents_without_a_language_go(spark):
    docs = read(spark, SF, "documents")
    odd = docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "'123 456' as text", "lang", "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, docs.union(odd), SF)
    assert kept.filter("doc_id >= 100000").isEmpty()
    assert kept.count() == docs.filter("text is not null").count()
    assert language.UNKNOWN == "und"


def test_near_copies_of_five_word_similarity_go(spark):
    rng = np.random.default_rng(5)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    alike = lambda x, y: len(x & y) / len(x | y)
    texts = []
    for i in range(150):
        base = [f"w{x}" for x in rng.integers(0, 3000, (120, 300, 1000)[i % 3])]
        copy = list(base)
        for at in rng.choice(len(copy), int(rng.integers(1, 3 + len(copy) // 50)), replace=False):
            copy[at] = f"new{at}"
        texts += [" ".join(base), " ".join(copy)]
    # a chain: each is alike to the next, the ends aren't; and a group of many near copies
    chain = [f"c{x}" for x in range(100)]
    texts += [" ".join(f"z{x}" if x in range(0, 4 * i) else w for x, w in enumerate(chain)) for i in range(12)]
    texts += [" ".join(f"n{i}" if x == 40 else f"g{x}" for x in range(80)) for i in range(40)]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).select("doc_id").collect()}
    assert kept == {top(i) for i in range(len(texts))}
    assert 0.6 * 150 < sum(2 * k + 1 not in kept for k in range(150)) < 150


def test_parities_never_differ_in_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 7, 100, 900, 5000]
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in sizes]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 64, len(s) // 10, dtype=np.uint64)])) for s in sets]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = np.unpackbits(shingles.parities(np.concatenate(sets), cuts).view(np.uint8), axis=1)
    for x, p in zip(sets, bits, strict=True):
        for y, q in zip(sets, bits, strict=True):
            assert (p != q).sum() <= len(np.setxor1d(x, y))
    assert shingles.parities(np.zeros(0, np.uint64), np.array([0])).shape == (0, shingles.PARITY)
