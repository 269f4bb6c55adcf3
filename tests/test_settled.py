"""Cases that queries once got wrong or that grew too fast, each on small tables of its own."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tarn import driver, session
from tarn.operators import clones, cochange, graph
from tarn.plans import answers, review
from tarn.queries import answers as questions
from tarn.queries import common, worlds


def test_intents_folds_what_conversations_say(spark, tmp_path):
    """Words count without their accents wherever they come from; the SQL folded only the fixed questions."""
    said = ["¿Es FRÁGIL?", "Última vez", "dinámico", "huérfano", None, "romper", "nada", "éval"]
    talk = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string")
    talk.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = {(r["q"], r["intent"]) for r in driver.QUERIES["intents"](spark, str(tmp_path)).collect()}
    assert {("¿Es FRÁGIL?", "risk"), ("Última vez", "since"), ("huérfano", "dead"), (None, "none"), ("éval", "dynamic")} <= found
    assert found == set(con.sql(driver.ORACLES["intents"]).fetchall())


def _exchanges(df):
    """Into how many parts the shuffles of a plan deal rows by keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan)]


def test_pairs_and_graphs_are_dealt_by_their_rows(spark, monkeypatch, tmp_path):
    """A task's share of orders stayed a fixed fraction of the table, and so its memory grew with it."""
    monkeypatch.setattr(session, "ROWS", 50)
    lines = [(o, (o * 7 + k * k) % 40, k) for o in range(300) for k in range(1 + o % 7)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 6}") for p in range(40)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    parts = -(-len(lines) // 50)
    pairs = cochange.pair_counts(table, "l_orderkey", "l_partkey")
    graphs = [common.brand_graph(spark, str(tmp_path)), common.part_graph(spark, str(tmp_path))]
    assert all(n == parts for df in (pairs, *graphs) for n in _exchanges(df))
    in_order = {o: {p for x, p, _ in lines if x == o} for o in range(300)}
    expected = Counter((a, b) for items in in_order.values() if len(items) > 1 for a in items for b in items if a < b)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == expected
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for df, sql in zip(graphs, (common.G, common.P), strict=True):
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"WITH {sql} SELECT src, dst, n FROM g").fetchall())


def test_brand_graph_is_made_once_in_even_parts(spark, monkeypatch, tmp_path):
    """All lines were read and paired three times for one answer, and the fullest task had more of them the more parts there were."""
    monkeypatch.setattr(session, "ROWS", 800)
    lines = [(o, (o * o * 7 + k * k * 5 + o * k) % 60, k) for o in range(6000) for k in range(1 + o % 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 13}") for p in range(60)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    made, tables, dealt, cut = [], [], session.dealt, graph.cut
    monkeypatch.setattr(common, "dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(df) or cut(df))
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query in ("impact_bfs", "ask_impact", "tests_to_run"):
        made.clear(), tables.clear()
        found = driver.QUERIES[query](spark, str(tmp_path))
        assert len(made) == 1 and tables
        assert not any("lineitem.parquet" in f for df in (*tables, found) for f in df.inputFiles())
        rows = sorted(map(tuple, found.collect()))
        assert rows and rows == sorted(con.sql(driver.ORACLES[query]).fetchall())
    parts = -(-len(lines) // 800)
    counts = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == parts and max(counts) < 1.25 * len(lines) / parts


def test_common_orders_of_copies_are_told_within_their_groups(spark, monkeypatch, tmp_path):
    """All pairs of an order were joined with names and counts, in as many parts as the session shuffles to, whatever the table's size."""
    monkeypatch.setattr(session, "ROWS", 50)
    lines = [(o, (o * 7 + k * k) % 40, k) for o in range(300) for k in range(1 + o % 7)] + [(None, 3, 0), (7, None, 0)]
    # a part twice, one of two names that others have as well, one without a name, one that nobody orders
    names = [(p, f"n{p % 5}") for p in range(39)] + [(3, "n3"), (8, "n4"), (9, "n3"), (39, None), (99, "n1")]
    spark.createDataFrame([x for x in lines if None not in x], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    table = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int")
    parts = -(-len(lines) // 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = driver.QUERIES["clone_co_rate"](spark, str(tmp_path))
        # the rates of the groups alone are dealt as the session says
        assert sorted({n for n in _exchanges(found)}) == [4, parts] and _exchanges(found).count(4) == 1
        assert {*_exchanges(cochange.associated(table, "l_orderkey", "l_partkey")), *_exchanges(cochange.item_counts(table, "l_orderkey", "l_partkey"))} == {parts}
        rows = sorted(map(tuple, found.collect()))
        of = spark.createDataFrame(names, "item long, group string")
        met = {tuple(r) for r in cochange.pair_counts(table, "l_orderkey", "l_partkey", groups=of).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert len(rows) == 5 and rows == sorted(con.sql(driver.ORACLES["clone_co_rate"]).fetchall())
    in_order = {o: {p for x, p, _ in lines if x == o and p is not None} for o in range(300)}
    assert met == {(g, a, b, n) for g, a, b in {(g, a, b) for a, g in names for b, h in names if g and g == h and a < b} if (n := sum({a, b} <= items for items in in_order.values()))}


def test_partners_are_told_in_parts_that_follow_the_pairs(spark, monkeypatch):
    """All pairs, both ways round, came to one task as long as they were few bytes."""
    monkeypatch.setattr(session, "ROWS", 50)
    pairs = [(a, b, 1 + (a * b) % 7, 0.1 * (1 + (a + b) % 5), a % 2 == b % 2) for a in range(30) for b in range(a + 1, 30) if (a * 3 + b) % 4]
    changed = set(range(0, 30, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = review.together(spark.createDataFrame([(i,) for i in changed], "id long"), spark.createDataFrame(pairs, "a long, b long, count long, strength double, hidden boolean"))
        assert set(_exchanges(found)) == {-(-2 * len(pairs) // 50)}
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = [(x, y, n, s, not h) for a, b, n, s, h in pairs for x, y in ((a, b), (b, a)) if x in changed and y not in changed]
    best = {i: sorted((r for r in sides if r[0] == i), key=lambda r: (-(r[2] * r[3]), r[1]))[:5] for i in changed}
    assert rows == sorted(r for each in best.values() for r in each)


def _impacted(links, nodes, cap, ids):
    """Who depends on each node, by a plain search."""
    found = {}
    for seed in nodes:
        depth, new, d = {seed: 0}, {seed}, 0
        while new and len(depth) <= cap:
            d += 1
            new = {s for s, t in links if t in new} - set(depth)
            depth |= dict.fromkeys(new, d)
        order = sorted((d, n) for n, d in depth.items() if n != seed)
        kept = order[: cap - 1]
        if kept:
            at = [d for d, _ in kept]
            found[seed] = (len(kept), at.count(1), at[-1], len(order) >= cap, [at.count(d) for d in range(1, at[-1] + 1)], [n for _, n in kept[:ids]])
    return found


def test_impact_of_long_chains_takes_few_rounds(spark, monkeypatch):
    """A round for each step of a chain, each of which wrote all that was found again."""
    chain = [(f"a{i:03}", f"a{i + 1:03}") for i in range(200)]
    # a tree that joins a chain, a fork before a chain, a cycle and what it leads to, a link to itself
    more = [(f"h{i}", f"h{i + 1}") for i in range(6)] + [("b0", "h6"), ("b1", "b0"), ("c0", "d0"), ("c1", "d0"), ("d0", "d1"), ("d1", "d2"), ("e0", "e1"), ("e1", "e2"), ("e2", "e0"), ("e2", "e3"), ("f0", "f0"), ("f0", "f1"), ("g0", "g1"), ("g1", "g2"), ("g2", "g0")]
    tables, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(df) or cut(df))
    for links, cap, ids in ((chain, 2500, 12), (chain, 20, 300), (more, 2500, 300), (more, 3, 2)):
        tables.clear()
        nodes = sorted({n for link in links for n in link} - {"a007"})
        df = spark.createDataFrame(links + links[:2], "src string, dst string")
        found = graph.impact(df, spark.createDataFrame([(n,) for n in nodes] * 2, "id string"), cap=cap, ids=ids)
        assert {r["node"]: tuple(r)[1:] for r in found.collect()} == _impacted(set(links), nodes, cap, ids)
        if links is chain:
            assert len(tables) < 20


def test_texts_are_read_once_for_near_copies(spark, monkeypatch, tmp_path):
    """Texts were split and their shingles made four times, and all shingles were dealt three times."""
    spoken = [" ".join(f"w{(i * i * 7 + i * k) % 97}" for i in range(60)) for k in range(12)]
    texts = [t for s in spoken for t in (s, s.upper() + "\n", "intro " + s, s + " end of it")]
    texts += [None, "", "few words", " ".join("same words again and again".split() * 30), " ".join("same words again and again".split() * 31), "a\u00a0b c d e f g h i j k l m n o p", "a\u00a0b c d e f g h i j k l m n o q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made, sets = [], clones.shingle_sets
    monkeypatch.setattr(clones, "shingle_sets", lambda *a, **k: made.append(1) or sets(*a, **k))
    found = driver.QUERIES["near_clones"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert made == [1] and "documents.parquet" not in plan and "MapInArrow" not in plan
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) > 12 and sorted(rows) == sorted(con.sql(driver.ORACLES["near_clones"]).fetchall())


def test_impact_follows_every_dependent(spark, tmp_path):
    """A part that 2,500 others depend on wasn't followed further, nor a chain of as many counted whole; the SQL counts all."""
    # 1,300 parts come before part 0 in two orders each, and another 1,300 before those
    met = [(2 * i + k, n, part) for i in range(1, 2601) for k in range(2) for n, part in ((1, i), (2, max(i - 1300, 0)))]
    spark.createDataFrame(met, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rows = sorted(map(tuple, driver.QUERIES["part_impact"](spark, str(tmp_path)).collect()))
    assert rows[0] == ("p0", 2600, 1300, 2, False) and rows == sorted(con.sql(driver.ORACLES["part_impact"]).fetchall())
    chain = spark.range(2600).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    last = graph.impact(chain, spark.createDataFrame([(2600,), (2599,)], "id long"), ids=3).collect()
    assert sorted((r["node"], r["total"], r["direct"], r["depth"], r["capped"], len(r["levels"]), r["ids"]) for r in last) == [(2599, 2599, 1, 2599, False, 2599, [2598, 2597, 2596]), (2600, 2600, 1, 2600, False, 2600, [2599, 2598, 2597])]


def test_words_of_questions_travel_without_their_texts(spark, monkeypatch):
    """Each word of a question took the whole text along, twice, to where names meet words, once names were too many to broadcast."""
    files = ["src/pay.js", "src/cart.js", "lib/pay.js", "a.b/deep.name.js", "p12", "p123", "x+y.c", "ab"]
    asked = ["what breaks if pay changes", "PAY.js or cart?", "p123, p12", "p1234", "src/cart.js", "deep.name", "x+y.c", "x y c", "ab", "nothing", "", None, "páy", "p12 p12"] + ["p12"] * 3
    tables = []
    monkeypatch.setattr(answers, "cut", lambda df: tables.append(df) or session.cut(df), raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = answers.named_file(spark.createDataFrame([(q,) for q in asked], "question string"), "question", spark.createDataFrame([(f,) for f in files], "id string"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, *tables)]
        rows = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    carried = [x for plan in plans for x in re.findall(r"Generate explode\(.*, \[([^\]]*)\], false, \[word#", plan)]
    assert carried and all(re.fullmatch(r"(h#\d+L)?", x) for x in carried)

    def named(q):
        folded = (q or "").lower().replace("á", "a")
        keys = {(k.lower(), f) for f in files for k in (f, f.split("/")[-1], re.sub(r"\.[^.]+$", "", f.split("/")[-1])) if len(k) >= 3}
        met = [(-len(k), f) for k, f in keys if re.search(rf"(^|[^a-z0-9]){re.escape(k)}($|[^a-z0-9])", folded)]
        return min(met)[1] if met else None

    assert rows == sorted([(q, named(q)) for q in asked], key=str)
    assert {f for _, f in rows} == {None, "lib/pay.js", "p123", "p12", "src/cart.js", "a.b/deep.name.js", "x+y.c"}


def test_chains_carry_their_first_ids_until_they_have_them(spark, monkeypatch):
    """Every round of a chain wrote and dealt the ids again, though the first four had made the twelve that are asked for."""
    tables, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(df) or cut(df))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    for ids in (0, 1, 3, 12, 400):
        tables.clear()
        rows = {tuple(r[:2]) + (tuple(r[2]),) for r in graph.straight(chain, ids=ids).collect()}
        assert rows == {(i, 300 - i, tuple(range(i + 1, 301))[:ids]) for i in range(300)}
        rounds = [df for df in tables if "live" in df.columns]
        assert sum("ids" in df.columns for df in rounds) == {0: 1, 1: 1, 3: 3, 12: 5, 400: 10}[ids]


def test_sales_of_questions_are_dealt_once(spark, monkeypatch):
    """All lines were dealt by part and supplier and again by part, and a third time for what files count of them."""
    monkeypatch.setattr(session, "ROWS", 400)
    tables = []
    monkeypatch.setattr(questions, "cut", lambda df: tables.append(df) or session.cut(df))
    d = "/root/testdata/sf0.001"
    facts = questions.facts_of(spark, d)
    lines = common.read(spark, d, "lineitem")
    assert _exchanges(tables[0]) == [-(-lines.count() // 400)]
    assert "count(distinct" not in tables[1]._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    told = sorted(tuple(r) for r in facts.files.select("id", "fan_in", "c90", "sole_owner").collect())
    assert told == sorted(con.sql(f"WITH {worlds.FILES} SELECT 'p' || id, fan_in, c90, sole_owner FROM f").fetchall())
    sold = sorted(tuple(r) for r in facts.shares.select("id", "author", "commits").collect())
    assert sold == sorted(con.sql("SELECT 'p' || l_partkey, 's' || l_suppkey, count(*) FROM lineitem GROUP BY ALL").fetchall())
