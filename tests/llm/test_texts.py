"""Language, pieces, decontamination, URLs, quality and shards against plain versions and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tarn.llm import decontaminate, language, quality, sentencepieces, sharding, url_filter
from tarn.llm.queries import PIECES, RULES

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, id string, votes int, lang_pred2 string, host string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y", "z") for i, t in rows], EXTRA)


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language.fit(table.filter(~language.held_out()))
    found = language.identify(table, profiles).filter(language.held_out()).select("lang", "lang_pred").collect()
    assert len(found) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97


def test_language_against_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").select("text", "lang").limit(300).collect()

    def plain_grams(text):
        seen = Counter()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            ends = "\x01" + word + "\x01"
            seen.update(word)
            for n in (2, 3):
                seen.update(ends[i : i + n] for i in range(len(ends) - n + 1))
        number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return sorted(((number(g), n) for g, n in seen.items()), key=lambda x: (-x[1], x[0]))

    table = {}
    for r in rows[:200]:
        if r["lang"]:
            table.setdefault(r["lang"], Counter()).update(dict(plain_grams(r["text"])))
    ranked = {lang: {g: i for i, (g, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: language.RANKS])} for lang, seen in table.items()}
    profiles = language.Profiles.of([(lang, g, i) for lang, ranks in ranked.items() for g, i in ranks.items()])
    for text in [r["text"] for r in rows] + ["a", "ÄÖ ß", "x1y 2 z", "İstanbul ﬁn"]:
        assert list(zip(*(x.tolist() for x in language.grams(text)), strict=True)) == plain_grams(text)
        own = [g for g, _ in plain_grams(text)[: language.RANKS]]
        away = {lang: sum(abs(i - ranks[g]) if g in ranks else language.RANKS for i, g in enumerate(own)) for lang, ranks in ranked.items()}
        if own:
            nearest = min(away, key=lambda x: (away[x], x))
            assert profiles.predict(text) == (nearest, pytest.approx(1 - away[nearest] / (language.RANKS * len(own))))


def test_any_number_of_languages(spark, monkeypatch):
    """600 languages of one word each, in parts of 250: the same as at once; equal distances go by name."""
    rows = [(i, "".join("abcdefghij"[int(d)] for d in f"{i % 600:03d}7{i % 600:03d}") + " wort", f"l{i % 600:03d}") for i in range(1200)] + [(5000, "gleich", "zz"), (5001, "gleich", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.fit(table)
    assert len(whole.names) == 602 and whole.rest == ()
    monkeypatch.setattr(language, "AT_ONCE", 250)
    parts = language.fit(table)
    assert [len(p.names) for p in parts.parts] == [250, 250, 102]
    found, same = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(table.select("doc_id", "text"), p).collect()} for p in (whole, parts))
    assert found == same and all(same[i][0] == lang for i, _, lang in rows[:600]) and same[5000] == same[5001] == ("aa", 1.0)
    assert all(parts.predict(t)[0] == same[i][0] and parts.predict(t)[1] == pytest.approx(same[i][1]) for i, t, _ in rows[:50])


def test_language_edges(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language.fit(table)
    rows = language.identify(docs(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "der die und nicht schön"), (5, "the " * 40000)]), profiles).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(docs(spark, []), profiles).collect() == []
    assert language.fit(table.limit(0)).names == []


def plain_best(pieces, text):
    """The best score over all segmentations, by a full table."""
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + pieces.longest) + 1):
            if text[i:j] in pieces.pieces:
                best[j] = max(best[j], best[i] + pieces.pieces[text[i:j]][2])
        if text[i] not in pieces.pieces:
            best[i + 1] = max(best[i + 1], best[i] + pieces.fallback)
    return best[-1]


def test_pieces_come_back_and_are_best(spark):
    pieces = sentencepieces.Pieces.load(PIECES)
    texts = ["Hello world, hello!", "  two  spaces ", "ñandú ▁ literal", "a" * 3000, "日本語 text\nline\t.", "", None, "x\u0000y"]
    table = docs(spark, list(enumerate(texts)))
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(table, pieces), pieces).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    scores = {number: s for _, number, s in pieces.pieces.values()}
    spaced = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 3000").limit(20).select("text").collect()]
    for t, whole in [(t, whole) for t in [*filter(None, texts[:5]), *spaced] for whole in (True, False)]:
        marked = "▁" + t.replace("▁", "\udc81").replace(" ", "▁")
        total, at, raw = 0.0, 0, [i for part in pieces.stream(marked) for i in part] if whole else pieces.encode(t)
        byte_ids = {i: b for b, i in enumerate(pieces.byte_ids)}
        while at < len(raw):
            if raw[at] in scores:
                total, at = total + scores[raw[at]], at + 1
            else:
                n = next(k for k in range(1, 5) if _char([byte_ids[x] for x in raw[at : at + k]]))
                total, at = total + pieces.fallback, at + n
        assert total == plain_best(pieces, marked)
    assert sentencepieces.encode(docs(spark, []), pieces).collect() == []


def test_paths_meet_and_ids_leave():
    pieces = sentencepieces.Pieces.load(PIECES)
    for text in ("a" * 20_000, "ab" * 10_000, "x1y " * 5_000):
        parts = list(pieces.stream(text))
        assert len(parts) > 1000 and max(map(len, parts)) <= 2 * pieces.longest
    rng = np.random.default_rng(5)
    small = sentencepieces.Pieces([(i, p, s) for i, (p, s) in enumerate([("a", -2.5), ("b", -3.0), ("ab", -3.1), ("ba", -3.3), ("aba", -4.2), ("bb", -5.9), ("abab", -6.25)])], [], 99)
    for _ in range(300):
        text = "".join(rng.choice(list("aabbc"), size=rng.integers(0, 60)))
        ids = [i for part in small.stream(text) for i in part]
        of = {i: (p, s) for p, (_, i, s) in small.pieces.items()}
        assert sum(of[i][1] if i != 99 else small.fallback for i in ids) == plain_best(small, text)
        assert re.fullmatch("".join(of[i][0] if i != 99 else "c" for i in ids), text)


def test_ids_against_the_models_own():
    """The model's merges aren't a search for the best path; most ids are the same."""
    own, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Pieces.load(PIECES)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t][:150]
    a, b = ([Counter(ids) for ids in found] for found in (own.encode(texts), map(pieces.encode, texts)))
    assert sum((x & y).total() for x, y in zip(a, b, strict=True)) > 0.8 * sum(x.total() for x in a)
    assert abs(sum(x.total() for x in b) / sum(x.total() for x in a) - 1) < 0.03


def test_pieces_of_null_ids_repeats_and_names(spark):
    pieces = sentencepieces.Pieces.load(PIECES)
    table = spark.createDataFrame([(None, "one two", 1), (7, "one two", 2), (7, "one two", 2), (8, None, 3)], "doc_id long, text string, ids int")
    found = sentencepieces.decode(sentencepieces.encode(table, pieces), pieces).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]) > 0, r["text"]) for r in found) == [("7", True, "one two"), ("7", True, "one two"), ("8", False, ""), ("None", True, "one two")]
    assert sentencepieces.decode(sentencepieces.encode(table.limit(0), pieces), pieces).collect() == []


def _char(raw):
    try:
        return len(bytes(raw).decode()) == 1
    except UnicodeDecodeError:
        return False


def test_contamination_in_one_part_and_in_several(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:15])), (2, "Short ITEM here"), (3, None), (4, ""), (5, " ".join(words[20:30])), (10, "short item here")]
    texts = [(1, "x " + " ".join(words[:12]) + " y"), (2, "a short, item; here! " * 2), (3, None), (4, " ".join(words)), (5, "clean " * 300), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    expected = {}
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for k, item in items:
            x = split(item)
            n = min(10, len(x))
            for s in {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == s:
                        hit |= set(range(p, p + n))
                        found.add(k)
        expected[i] = (len(w), len(hit), sorted(found))
    for size in (1 << 20, 60, 4):
        rows = decontaminate.contamination(docs(spark, texts), bench, part_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["begin"] for s in r["spans"]), list(r["items"])) for r in rows} == expected
    assert decontaminate.contamination(docs(spark, []), bench).collect() == []
    assert all(not r["items"] for r in decontaminate.contamination(docs(spark, texts), bench.limit(0)).collect())


def test_contamination_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "x y"), (1, "x y"), (None, "p q r"), (None, "clean"), (None, None), (2, "b c" * 50_000)]
    for kind in ("smallint", "string", "decimal(9,2)", "long"):
        bench = spark.createDataFrame([(1, "b c"), (2, "x y"), (2, "q r"), (3, "y x b")], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text", "1 as spans")
        found = []
        for size in (1 << 25, 4):
            got = decontaminate.contamination(docs(spark, rows).repartition(3), bench, part_bytes=size).collect()
            found.append(sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], [str(float(i)) for i in r["items"]]) for r in got))
        assert found[0] == found[1] and len(found[0]) == len(rows)
        assert [x[2:] for x in found[0] if x[0] == "None"] == [([], []), ([], []), ([(1, 3)], ["2.0"])]
    for size in (1 << 25, 4):
        kept = decontaminate.clean(docs(spark, [*rows, (3, "x y"), (3, "fine")]), bench, part_bytes=size)
        assert kept.columns == docs(spark, []).columns
        assert sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in kept.collect()) == [("2", "b cb "), ("3", "fine"), ("None", "None"), ("None", "clean")]
    assert decontaminate.clean(docs(spark, []), bench).collect() == []


def test_rules_and_links(spark):
    html = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts) + '<a href="/own">'
    rows = [
        (1, "http://WWW.Example.org/es/1", html()), (2, "http://example.org/en/12?x", html()), (3, "http://a.org/x#y", html("friend.net")),
        (4, "http://b.com/de/1", html()), (5, "http://friend.net/1", html()), (6, "http://foe.net/1", html("b.com")), (7, "http://lone.net", html()),
        (8, None, None), (9, "no scheme", ""), (10, "http://b.com/fr/1", None), (11, "http://a.org", None),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, rule string, src string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in found.items()} == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/de/", "block"), 5: (None, "allow"), 6: (None, "block"),
        7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("com/fr/", "allow"), 11: (None, "allow"),
    }
    assert found[5]["trust"] > 0 and found[6]["distrust"] > 0 and (found[8]["host"], found[8]["path"]) == ("", "")
    assert url_filter.judge(pages.limit(0), RULES).collect() == []
    assert url_filter.judge(pages, []).filter("verdict = 'block'").count() == 0


def test_quality_of_labelled_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = quality.classify(table).join(labels, "doc_id").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_labellers_that_err_weigh_less():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    right = [0.95, 0.9, 0.6]
    cast = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in right], 1) * 2 - 1
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    good, accuracy = quality.posteriors([(p.tolist(), int(c)) for p, c in zip(patterns, counts, strict=True)])
    assert np.allclose(accuracy, right, atol=0.06)
    by = {tuple(p): g for p, g in zip(patterns.tolist(), good, strict=True)}
    assert by[(1, 1, -1)] > 0.9 and by[(-1, -1, 1)] < 0.1


def test_the_sample_is_the_same_in_every_run(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    one, two = (quality.train(table.repartition(n), sample=50) for n in (3, 7))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_trust_goes_as_far_as_links_do(spark):
    chain = [(i, f"http://h{i}.net/", f"<a href=http://h{i + 1}.net/>") for i in range(40)] + [(99, "http://b.com/de/1", "")]
    pages = spark.createDataFrame([(100, "http://foe.net/", '<a href="http://b.com/">'), (101, "http://a.org/", "<a href='//h0.net/'>"), *chain], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    assert all(found[i]["trust"] > 0 and found[i]["verdict"] == "allow" for i in range(40))
    assert found[39]["trust"] == pytest.approx(0.15 * 0.85**40)
    assert found[100]["verdict"] == "block"


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "A plain sentence of words, and one more."), (4, "A plain sentence of words, and one more."), (None, "@@ ## $$ %% &&"), (5, "long words here. " * 8000)]
    found = quality.classify(docs(spark, rows)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert not any(r["kept"] for r in found if r["doc_id"] in (1, 2, 3))
    assert quality.classify(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 10)
    there = f.forward(np.arange(n))
    assert sorted(there.tolist()) == list(range(n))
    assert f.back(there).tolist() == list(range(n))


def test_shards(spark):
    rows = [(i, "t" * (i % 50)) for i in range(997)] + [(5, "again"), (None, None), (1000, "é")]
    found = sharding.shard(docs(spark, rows).repartition(6), 24, seed=10).collect()
    assert len(found) == len(rows)
    sizes = {(i, t): (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted(sizes[x] for x in rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard(docs(spark, rows).repartition(3), 24, seed=10).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, found), key=str) == sorted(map(key, again), key=str)
    assert sharding.shard(docs(spark, []), 24).collect() == []


def test_rows_keep_their_order(spark):
    numbered = sharding.number_rows(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"])
    assert all(r["v"] == r["row"] for r in numbered.collect())
