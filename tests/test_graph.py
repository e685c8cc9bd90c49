"""Graph algorithms on graphs small enough to reckon by hand."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom import model as m
from graphloom.functions.stem import stem
from graphloom.operators import graph, retrieval
from graphloom.plans.fixpoint import connected_components
from graphloom.plans.forest import spanning_forest
from graphloom.plans.scratch import materialise


def make(spark, names, pairs):
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    return nodes, spark.createDataFrame([(*p, "t") for p in pairs], "src string, dst string, template_id string")


def scores(df, value="score"):
    return {r.id: r[value] for r in df.collect()}


def test_seeds_draw_rank(spark):
    got = scores(graph.pagerank(*make(spark, "abcd", ["ab", "bc", "ad"]), seeds={"a": 1.0}))
    assert got["a"] > got["c"] and sum(got.values()) == pytest.approx(1)
    got = scores(graph.pagerank(*make(spark, "abc", ["ac", "bc"]), seeds={"a": 0.7, "b": 0.3, "nobody": 9.0}))
    assert got["a"] > got["b"] and "c" in got


def test_empty_graph(spark):
    nodes, edges = make(spark, "", [])
    assert graph.pagerank(nodes, edges).count() == 0
    assert graph.components(nodes, edges).count() == 0
    assert connected_components(edges).count() == 0


def test_components_and_unknown_ends(spark):
    got = {r.id: r.component for r in graph.components(*make(spark, "abcde", ["ab", "ba", "dc", "ez"])).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id src", "id + 1 dst")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_shortest_path(spark):
    nodes, edges = make(spark, "abcdx", ["ab", "bc", "ad", "dc"])
    assert graph.shortest_path(nodes, edges, "a", "c").first().path == ["a", "b", "c"]
    assert graph.shortest_path(nodes, edges, "a", "a").first().length == 0
    assert graph.shortest_path(nodes, edges, "a", "x").first().length is None
    with pytest.raises(ValueError):
        graph.shortest_path(nodes, edges, "a", "nobody")


def test_betweenness_and_clustering(spark):
    nodes, edges = make(spark, "abcd", ["ab", "bc", "cd"])
    assert scores(graph.betweenness(nodes, edges)) == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    nodes, edges = make(spark, "abcd", ["ab", "bc", "ca", "cd"])
    assert scores(graph.clustering(nodes, edges), "coefficient") == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0})


def test_bridges(spark):
    got = {(r.src, r.dst) for r in graph.bridges(*make(spark, "abcde", ["ab", "bc", "ca", "cd", "de"])).collect()}
    assert got == {("c", "d"), ("d", "e")}


def test_pagerank_against_a_loop(spark):
    rng = random.Random(4)
    names = [f"n{k:02}" for k in range(30)]
    pairs = [(rng.choice(names), rng.choice(names + ["lost"])) for _ in range(70)]
    nodes, edges = make(spark, names, pairs)
    links = Counter(p for p in pairs if p[1] != "lost")
    out = Counter()
    for (a, _), k in links.items():
        out[a] += k
    rank = dict.fromkeys(names, 1 / 30)
    for _ in range(200):
        lost = sum(v for n, v in rank.items() if n not in out)
        after = {n: 0.15 / 30 + 0.85 * lost / 30 for n in names}
        for (a, b), k in links.items():
            after[b] += 0.85 * rank[a] * k / out[a]
        change, rank = sum(abs(after[n] - rank[n]) for n in names), after
        if change < 30 * 1e-6:
            break
    assert scores(graph.pagerank(nodes, edges)) == pytest.approx(rank, abs=1e-12)


def parts(names, pairs):
    root = {n: n for n in names}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[find(a)] = find(b)
    return len({find(n) for n in names})


def test_bridges_against_removal(spark):
    rng = random.Random(6)
    names = [f"n{k:02}" for k in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(46)]
    simple = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    want = {e for e in simple if parts(names, simple - {e}) > parts(names, simple)}
    nodes, edges = make(spark, names, pairs + pairs[:3])
    assert {(r.src, r.dst) for r in graph.bridges(nodes, edges).collect()} == want and len(want) > 8
    assert graph.bridges(*make(spark, "ab", [])).count() == 0


def test_bridges_of_a_deep_graph(spark):
    """A chain of 4,000 nodes with a ring at its end and a hub of 300 leaves: rounds don't follow the depth."""
    chain = [(f"c{k:05}", f"c{k + 1:05}") for k in range(4000)]
    ring = [(f"c{4000 + k:05}", f"c{4001 + k:05}") for k in range(50)] + [("c04050", "c04000")]
    hub = [("c00000", f"h{k:03}") for k in range(300)]
    names = sorted({n for p in chain + ring + hub for n in p})
    nodes, edges = make(spark, names, chain + ring + hub)
    assert {(r.src, r.dst) for r in graph.bridges(nodes, edges).collect()} == {(min(p), max(p)) for p in chain + hub}


def test_forest_spans_without_cycles(spark):
    rng = random.Random(9)
    names = [f"n{k:03}" for k in range(150)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(170)})
    taken = [tuple(r) for r in spanning_forest(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert len(taken) == len(set(taken)) and set(taken) <= set(pairs)
    assert parts(names, taken) == parts(names, pairs) == len(names) - len(taken)
    assert spanning_forest(spark.createDataFrame([], "a string, b string")).count() == 0


def test_betweenness_in_batches_and_from_some_sources(spark):
    rng = random.Random(2)
    names = [f"n{k}" for k in range(25)]
    nodes, edges = make(spark, names, [tuple(rng.sample(names, 2)) for _ in range(40)])
    whole = scores(graph.betweenness(nodes, edges))
    assert scores(graph.betweenness(nodes, edges, most_pairs=200)) == pytest.approx(whole)
    halves = [scores(graph.betweenness(nodes, edges, nodes.where(f"substring(id, 2) % 2 = {k}").limit(30))) for k in (0, 1)]
    assert {n: (13 * halves[0][n] + 12 * halves[1][n]) / 25 for n in names} == pytest.approx(whole)


def test_walk_order_and_paths(spark):
    nodes = spark.createDataFrame([(n, n.upper()) for n in "abcdex"], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "t"), ("c", "a", "t"), ("b", "d", "u"), ("c", "d", "t"), ("d", "e", "t"), ("a", "z", "t")], "src string, dst string, template_id string")
    walk = {r.id: (r.depth, [tuple(x) for x in r.path]) for r in graph.traverse(nodes, edges, "a").collect()}
    assert walk == {"b": (1, [("b", "t", "out")]), "c": (1, [("c", "t", "in")]), "d": (2, [("b", "t", "out"), ("d", "u", "out")]), "e": (3, [("b", "t", "out"), ("d", "u", "out"), ("e", "t", "out")])}
    assert {r.id for r in graph.traverse(nodes, edges, "a", "out", ["t"]).collect()} == {"b"}
    assert [r.id for r in graph.traverse(nodes, edges, "a", limit=1).collect()] == ["b"]
    assert graph.traverse(nodes, edges, "x").count() == 0


def test_betweenness_of_nations_against_a_search(spark, data):
    rows = catalog.queries()["graph_betweenness"](spark, data).collect()
    names = [r.id for r in rows]
    around = defaultdict(set)
    for e in m.small_edges(spark, data).collect():
        if e.src in names and e.dst in names and e.src != e.dst:
            around[e.src].add(e.dst)
            around[e.dst].add(e.src)
    score = dict.fromkeys(names, 0.0)
    for s in names:
        order, before, paths, far = [], defaultdict(list), Counter({s: 1}), {s: 0}
        queue = [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in sorted(around[v]):
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        owed = Counter()
        for w in reversed(order):
            for v in before[w]:
                owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                score[w] += owed[w]
    n = len(names)
    assert {r.id: r.score for r in rows} == pytest.approx({k: round(v / ((n - 1) * (n - 2)), 8) for k, v in score.items()}, abs=1e-6)


def test_structure_report(spark):
    got = {(r.section, r.place, r.id): r.value for r in graph.structure_report(*make(spark, "abcdef", ["ab", "bc", "ca", "de"])).collect()}
    facts = {i: v for (s, _, i), v in got.items() if s == "facts"}
    assert facts == {"nodes": 6, "links": 4, "isolated": 1, "communities": 3, "average_degree": round(8 / 6, 4), "average_clustering": 0.5}
    assert [k for k in got if k[0] == "community"] == [("community", 1, "a"), ("community", 2, "d"), ("community", 3, "f")]
    assert {i for s, p, i in got if s == "member" and p == 1} == {"a", "b", "c"}


def test_stems():
    # Words and stems of the published algorithm's examples.
    known = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope formality formal triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt activate activ effective effect probate probat rate rate cease ceas controll control roll roll"
    words = known.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


def test_keyword_search_by_stems(spark):
    docs = spark.createDataFrame([(1, "Cats", "running fast"), (2, "Dog", "a cat ran and runs"), (3, None, None), (4, "bird", "sky"), (5, "fish", "sea")], "doc_id bigint, label string, text string")
    got = {r.id: r.score for r in retrieval.keyword(docs, ["cat", "RUN"], retrieval.FIELDS, stemmed=True).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    assert retrieval.keyword(docs, [], retrieval.FIELDS).count() == 0 and retrieval.keyword(docs.limit(0), ["cat"], retrieval.FIELDS).count() == 0


def test_modes_of_graph_search(spark):
    nodes = spark.createDataFrame([("a", "Ann", "p"), ("b", "Bob", "p"), ("c", "Cat", "p")], "id string, label string, template_id string")
    edges = spark.createDataFrame([("a", "b", "knows"), ("b", "c", "has")], "src string, dst string, template_id string")
    chunks = spark.createDataFrame([(1, 10, "s", "Ann knows Bob"), (2, 10, "s", "nothing here"), (3, 11, "t", "Bob has a cat")], "chunk_id bigint, doc_id bigint, source_id string, content string")
    cited = spark.createDataFrame([("b", 3), ("a", 1)], "entity_uri string, chunk_id bigint")
    near = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    chunk_near = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<double>")
    ask = lambda text, vector, **how: graph.graph_search(nodes, edges, cited, chunks, near, chunk_near, text, vector, **how)
    full = ask("knows", [1.0, 0.0])
    assert full.stats == {"mode": "full_graphrag", "seeds": 1, "vector_chunks": 1, "provenance_chunks": 2, "triples": 2}
    assert {(r.id, r.origin) for r in full.chunks.collect()} == {(1, "both"), (3, "provenance")} and "Ann knows Bob" in full.context
    assert ask("knows", [-1.0, 0.0]).stats["mode"] == "vector_only"
    words = ask("knows", [])
    assert words.stats["mode"] == "keyword_only" and [r.id for r in words.chunks.collect()] == [1]
    assert ask("knows", [], scope=["t"]).chunks.count() == 0
    assert full.chunks.where(F.col("alias") == "C0").count() == 1


def test_scores_are_those_of_the_full_text_index(spark, data):
    """Words, stems, folded letters and weights of three fields over all documents, against the tokenizer itself."""
    import sqlite3

    rows = [(r.doc_id, *((r.text or "").split("\n", 1) + [""])[:2], f"{r.source} {r.lang}") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(9001, "Possible", "archaeology possibly", "Résumé"), (9002, "Relational operators", "the résumés of flies; Café", ""), (9003, "", "", "")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(label, properties, text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this build")
    db.executemany("INSERT INTO t(rowid, label, text, properties) VALUES (?, ?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, label string, text string, properties string")
    for terms in (["possible"], ["archaeologies", "resume"], ["relate", "operator", "cafe"], ["things", "de"], ["flying", "the"]):
        want = dict(db.execute("SELECT rowid, -bm25(t, 3.0, 1.0, 0.5) FROM t WHERE t MATCH ?", (" OR ".join(terms),)))
        got = {r.id: r.score for r in retrieval.keyword(docs, terms, retrieval.FIELDS, stemmed=True).collect()}
        assert set(got) == set(want) and got == pytest.approx(want, rel=1e-6), terms
        assert got


def test_resolving_names(spark):
    nodes = spark.createDataFrame([("a", "Pierre Bezukhov", "p", 1, {"nicknames": '["Petya","The Count"]', "titles": "Count"}), ("b", "Natasha", "p", 2, {"aliases": "", "also_known_as": "[broken"}), ("c", "Napoleon", "q", None, None), ("d", "Pierre", "p", 3, None)], "id string, label string, template_id string, source_id int, properties map<string,string>")
    near = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("x", [1.0, 0.0])], "id string, embedding array<double>")
    ask = lambda text, v, **how: [(r.place, r.id, r.method, r.aliases) for r in retrieval.resolved(nodes, text, near, v, **how).collect()]
    assert ask("petya", [])[0] == (0, "a", "keyword", ["Petya", "The Count", "Count"])
    assert [x[1:3] for x in ask("an enemy", [0.1, 1.0])] == [("c", "hybrid")]
    assert [x[1] for x in ask("an enemy", [1.0, 0.0], alternatives=0)] == ["a"]
    assert [x[1] for x in ask("an enemy", [1.0, 0.0], scope=[2])] == ["b"] and ask("an enemy", [1.0, 0.0])[1][3] == []
    assert ask("nobody", []) == [] and {x[1] for x in ask("pierre", [])} == {"a", "d"}


def test_clustering_against_pairs_of_neighbours(spark):
    """Hubs, parallel edges, loops and unknown ends; the work is a row per edge, with the neighbours upward of its ends."""
    rng = random.Random(4)
    names = [f"n{k:02}" for k in range(40)]
    pairs = [tuple(rng.choices(names, k=2)) for _ in range(200)] + [("n00", n) for n in names] + [("n01", "ghost")]
    around = defaultdict(set)
    for a, b in pairs:
        if a != b and b != "ghost":
            around[a].add(b)
            around[b].add(a)
    closed = lambda n: sum(b in around[a] for a in around[n] for b in around[n])
    want = {n: closed(n) / (len(around[n]) * (len(around[n]) - 1)) if len(around[n]) > 1 else 0.0 for n in names}
    out = graph.clustering(*make(spark, names, pairs))
    assert {r.id: r.coefficient for r in out.collect()} == pytest.approx(want)


def test_trees_are_taken_off_before_all_pairs(spark):
    """A thousand leaves on a ring of five, and a chain: all pairs are those of what is left, so one batch of 100 pairs does."""
    ring = [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)]
    pairs = ring + [(f"r{k % 5}", f"s{k}") for k in range(1000)] + [("x", "y"), ("y", "z")]
    names = sorted({n for p in pairs for n in p})
    nodes, edges = make(spark, names, pairs)
    left, rounds = graph.peeled(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), [])
    assert left.count() == 7 - sum(r.where("id in ('x', 'y', 'z')").count() for r in rounds) and sum(r.where("id like 's%'").count() for r in rounds) == 1000
    got = scores(graph.betweenness(nodes, edges, most_pairs=100))
    n, hung = len(names), 200
    # a ring node: its leaves with all, the leaves' pairs, and its two neighbours' trees
    ring_score = (hung * (hung - 1) + 2 * hung * (4 * (hung + 1)) + 2 * (hung + 1) ** 2) / ((n - 1) * (n - 2))
    assert [got[f"r{k}"] for k in range(5)] == pytest.approx([ring_score] * 5)
    assert got["s7"] == 0 and got["x"] == 0 and got["y"] == pytest.approx(2 / ((n - 1) * (n - 2)))


def test_structure_report_leaves_little_behind(spark):
    """What it writes and nothing reads any more goes, and so do the shuffles of each write."""
    from graphloom.plans import scratch

    nodes, edges = make(spark, "abcdefgh", ["ab", "bc", "ca", "de", "ab", "aa", "gh", "xy"])
    tags = Counter()
    home = Path(scratch.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in home.iterdir()} if home.exists() else set()
    got = {(r.section, r.id): r.value for r in graph.structure_report(nodes, edges).collect()}
    assert got["facts", "links"] == 5 and got["facts", "isolated"] == 1 and got["facts", "average_clustering"] == round(3 / 8, 6)
    want = scores(graph.pagerank(nodes, edges))
    assert {i: v for (s, i), v in got.items() if s == "rank"} == {i: round(v, 8) for i, v in want.items()}
    tags.update(p.name.rsplit("-", 1)[0] for p in home.iterdir() if p.name not in before)
    assert not {"edges", "links", "pairs", "both", "up", "tops"} & set(tags) and tags["parts"] == 1, tags


def test_shuffles_of_a_write_go_with_it(spark):
    (home,) = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kept = lambda: {p.name for p in Path(home).rglob("shuffle_*.data")}
    before = kept()
    materialise(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    assert not kept() - before


def test_triangles_in_passes(spark):
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if (a, b) != (3, 4)]
    around = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    want = {n: sum(1 for x in near for y in near if x < y and y in around[x]) for n, near in around.items()}
    written = []
    held = lambda df, tag: written.append(tag) or materialise(df, tag)
    _, corners = graph._corners(materialise(spark.createDataFrame(pairs, "a bigint, b bigint"), "given"), held, most_tops=1)
    assert {r.n: r.t for r in corners.collect()} == want
    assert written.count("corners") == 3  # an edge's neighbours are nine on average, four an edge are carried at once


def test_structure_report_is_whole(spark):
    names = [f"n{i:02}" for i in range(40)]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    pairs = [(names[i], names[i + 1]) for i in range(0, 24, 2)] + [(names[0], names[i]) for i in range(30, 37)]
    edges = spark.createDataFrame([(*p, "t") for p in pairs], "src string, dst string, template_id string")
    rows = graph.structure_report(nodes, edges).collect()
    of = lambda section: sorted((r.place, r.id, r.value) for r in rows if r.section == section)
    ends = Counter(x for p in pairs for x in p)
    assert of("degree") == [(k + 1, i, float(v)) for k, (i, v) in enumerate(sorted(((n, ends[n]) for n in names), key=lambda x: (-x[1], x[0])))]
    parts = scores(graph.components(nodes, edges), "component")
    sizes = sorted(Counter(parts.values()).items(), key=lambda x: (-x[1], x[0]))
    assert of("community") == [(k + 1, i, float(v)) for k, (i, v) in enumerate(sizes)] and len(sizes) == 21
    place = {i: k + 1 for k, (i, _) in enumerate(sizes)}
    assert {i: p for p, i, _ in of("member")} == {i: place[c] for i, c in parts.items()}
    want = scores(graph.pagerank(nodes, edges))
    assert [(i, v) for _, i, v in of("rank")] == sorted(((i, round(v, 8)) for i, v in want.items()), key=lambda x: (-x[1], x[0]))


def test_context_is_what_is_around_the_best(spark):
    nodes = spark.createDataFrame([("a", "Ann", "person"), ("b", "Bob", None), ("c", "Cem", "place")], "id string, label string, template_id string")
    edges = spark.createDataFrame([("c", "b", "t"), ("a", "b", "u"), ("a", "b", "u"), ("a", "x", "t"), ("c", "c", "t"), ("b", "a", "v")], "src string, dst string, template_id string")
    tops = spark.createDataFrame([("a", 2), ("b", 1)], "id string, place int")
    of = lambda **how: [tuple(r) for r in retrieval.neighbour_triples(edges, nodes, tops, **how).orderBy("place").select("subject", "relation", "object", "line", "shown").collect()]
    want = [("Bob", "v", "Ann", "Bob v Ann (person).", True), ("Cem", "t", "Bob", "Cem (place) t Bob.", True), ("Ann", "u", "Bob", "Ann (person) u Bob.", True), ("Ann", "t", "x", "Ann (person) t x.", True)]
    assert of() == want and of(limit=2) == want[:2]
    ends = [sum(len(w[3]) + 1 for w in want[: k + 1]) for k in range(4)]
    assert [r[4] for r in of(most=ends[1])] == [True, True, False, False]
    assert [r[4] for r in of(most=ends[3] - 1)] == [True] * 4 and [r[4] for r in of(most=ends[3] - 2)] == [True] * 3 + [False]


def test_context_follows_the_ranks(spark, data):
    """The best nodes are those that ranks from the nearest vectors make so, not the first by their names."""
    rows = catalog.queries()["graphrag_context"](spark, data).collect()
    assert any(r.seed for r in rows) and any(r.relation == "bought" for r in rows) and [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, len(rows) + 1))
