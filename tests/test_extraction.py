"""Extraction rules and entity resolution on small cases and against plain loops."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.operators import extraction as x
from graphloom.operators import resolution as r

ENTITY = "source_id bigint, chunk_index int, ordinal bigint, name string, type string, aliases array<string>, description string, sent_ref string, confidence double"
RELATION = "source_id bigint, chunk_index int, ordinal bigint, source bigint, target bigint, type string, sent_ref string, confidence double"


def entities(spark, *rows):
    """(ordinal, name, type, changes)."""
    base = {"source_id": 1, "chunk_index": 0, "aliases": [], "description": None, "sent_ref": "S1", "confidence": 0.5}
    return spark.createDataFrame([base | {"ordinal": o, "name": n, "type": k} | (more[0] if more else {}) for o, n, k, *more in rows], ENTITY)


def relations(spark, *rows):
    """(source, target, type, confidence)."""
    return spark.createDataFrame([(1, 0, i, a, b, k, "S1", c) for i, (a, b, k, c) in enumerate(rows)], RELATION)


RULES = [("spouse_of", ["Character", "Person"], ["Character", "Person"]), ("interacts_with", ["Character"], ["Character"]), ("resides_in", ["Character", "Person"], ["Location", "Place"])]


@pytest.mark.parametrize(
    ("row", "how", "want"),
    [
        ((0, 1, "spouse_of"), {}, (0, 1, "spouse_of", "exact", "kept")),
        ((0, 1, "interacts"), {}, (0, 1, "interacts_with", "fuzzy", "kept")),
        ((0, 2, "resides at home"), {}, (0, 2, "resides_in", "fuzzy", "kept")),
        ((0, 1, "totally_unknown"), {}, (0, 1, "totally_unknown", "none", "fell_through")),
        ((0, 1, "totally_unknown"), {"strict": True}, (0, 1, "totally_unknown", "none", "dropped")),
        ((2, 0, "resides_in"), {}, (0, 2, "resides_in", "exact", "swapped")),
        ((2, 0, "resides_in"), {"correct": False}, (2, 0, "resides_in", "exact", "dropped")),
        ((0, 1, "resides_in"), {}, (0, 1, "resides_in", "exact", "fell_through")),
        ((0, 1, "resides_in"), {"strict": True}, (0, 1, "resides_in", "exact", "dropped")),
        ((0, 3, "resides_in"), {"strict": True}, (0, 3, "resides_in", "exact", "dropped")),
        ((0, 3, "resides_in"), {}, (0, 3, "resides_in", "exact", "fell_through")),
    ],
)
def test_type_constraints(spark, row, how, want):
    e = entities(spark, (0, "Anna", "Character"), (1, "Pierre", "Character"), (2, "Moscow", "Location"), (3, "Untyped", None))
    rules = spark.createDataFrame(RULES, "name string, source_types array<string>, target_types array<string>")
    got = x.constrained(relations(spark, (*row, 0.9)), e, rules, **how).first()
    assert (got.source, got.target, got.type, got.matched, got.action) == want


def limited_by_loop(rows, n, degree, same, ratio, protect):
    degrees, types, kept, out = defaultdict(int), defaultdict(int), 0, {}
    for o, a, b, k, c in sorted(rows, key=lambda v: (-v[4], v[0])):
        if kept >= int(ratio * n):
            out[o] = "ratio"
        elif types[a, k] >= same:
            out[o] = "same_type"
        elif (degrees[a] >= degree or degrees[b] >= degree) and not (protect and ((degrees[a] < degree and degrees[a] < 2) or (degrees[b] < degree and degrees[b] < 2))):
            out[o] = "degree"
        else:
            out[o] = "kept"
            kept += 1
            types[a, k] += 1
            degrees[a] += 1
            degrees[b] += 1
    return out


def test_limits_against_a_loop(spark, data):
    want = {}
    per = defaultdict(list)
    for c in m.claims(spark, data).collect():
        per[c.source_id].append((c.ordinal, c.source, c.target, c.type, c.confidence))
    n = {g.source_id: g["count"] for g in m.mentions(spark, data).groupBy("source_id").count().collect()}
    for source, rows in per.items():
        want |= limited_by_loop(rows, n[source], 3, 2, 1.0, True)
    from graphloom import catalog

    got = {g.ordinal: g.outcome for g in catalog.queries()["rel_limits_degree"](spark, data).collect()}
    assert got == want and set(got.values()) >= {"kept", "ratio", "degree"}


def test_orphans_are_spared_only_when_asked(spark):
    e = entities(spark, *[(k, f"e{k}", "T") for k in range(6)])
    rel = relations(spark, (0, 1, "a", 0.9), (0, 2, "b", 0.9), (0, 3, "c", 0.9), (0, 5, "d", 0.5))
    for protect, want in ((True, "kept"), (False, "degree")):
        assert {g.ordinal: g.outcome for g in x.limited(rel, e, degree=3, same=50, protect=protect).collect()}[3] == want
    busy = relations(spark, *[(a, b, str(k), 0.9) for k, (a, b) in enumerate([(0, 1), (0, 2), (0, 3), (4, 1), (4, 2)])], (0, 4, "f", 0.5))
    assert {g.ordinal: g.outcome for g in x.limited(busy, e, degree=3, same=50, protect=True).collect()}[5] == "degree"


def test_evidence_modes(spark):
    said = spark.createDataFrame([(1, ["Anna Karenina met Vronsky.", "He works for the railway.", "Nobody else."])], "source_id bigint, sentences array<string>")
    e = entities(spark, (0, "Anna Arkadyevna", "Person"), (1, "Alexei", "Person", {"aliases": ["vronsky"]}), (2, "Al", "Person", {"sent_ref": "S2"}), (3, "Anna", "Person", {"sent_ref": "S9"}), (4, "Anna", "Person", {"sent_ref": None}), (5, None, None))
    want = {"off": [1] * 6, "relaxed": [1, 1, 1, 0, 0, 1], "standard": [1, 1, 0, 0, 0, 1], "strict": [0, 1, 0, 0, 0, 1], "narrative": [0, 1, 0, 0, 0, 1]}
    for mode, flags in want.items():
        got = {g.ordinal: g.grounded for g in x.entity_evidence(e, said, mode).collect()}
        assert [int(got[k]) for k in range(6)] == flags, mode
    rel = spark.createDataFrame([(1, 0, 0, 0, 1, "knows", "S1", 0.5), (1, 0, 1, 0, 3, "works_for", "S2", 0.5), (1, 0, 2, 0, 1, "x", "S1 to S2", 0.5), (1, 0, 3, 0, 77, "works_for", "S2", 0.5), (1, 0, 4, 1, 3, "likes", "S3", 0.5)], RELATION)
    want = {"relaxed": [1, 1, 1, 1, 1], "standard": [1, 0, 1, 0, 0], "narrative": [1, 1, 1, 0, 0], "strict": [0, 0, 0, 0, 0], "off": [1] * 5}
    for mode, flags in want.items():
        got = {g.ordinal: g.grounded for g in x.relation_evidence(rel, e, said, mode).collect()}
        assert [int(got[k]) for k in range(5)] == flags, mode


def test_plausibility(spark):
    texts = spark.createDataFrame([(1, "Then Napoleon saw Prince Andrei. Sword in hand, he sat in the armchair with a sword.")], "source_id bigint, text string")
    e = entities(spark, (0, "Prince Andrei", "Person"), (1, "The Sword", "Person"), (2, "Napoleon", "Person"), (3, "Unwritten", "Person"), (4, "", "Person"), (5, "Napoleon sword armchair hand", "Thing"), (6, None, None))
    got = {g.ordinal: (g.plausibility, g.kept) for g in x.plausible(e, texts, ("Person",)).collect()}
    assert got == {0: (1.0, True), 1: (0.0, False), 2: (1.0, True), 3: (1.0, True), 4: (0.0, False), 5: (0.25, True), 6: (0.0, False)}


def test_rescue(spark):
    e = entities(
        spark, (0, "Anna", "Person"), (1, "Princess", "Title"), (2, "the", "Ghost"), (3, "Ghost", "ghost"), (4, "X", "Role", {"description": "A place near"}), (5, "Y", "per"), (6, "Z", "Nothing"),
        (7, "Baron", "Title", {"chunk_index": 1}), (8, "Karl", "Person", {"chunk_index": 1}), (9, "Duke", "Title", {"chunk_index": 2}),
    )
    rel = relations(spark, (9, 0, "is", 0.5))
    got = {g.ordinal: (g.action, g.type, g.absorber) for g in x.rescued_types(e, rel, ["Person", "Place"], {"Place": ["place"], "Person": ["person"], "Ghost": ["z"]}, {"Title": ("Person", "title")}).collect()}
    assert got[1] == ("absorbed", "Title", 0) and got[7] == ("absorbed", "Title", 8) and got[9] == ("absorbed", "Title", 0)
    assert got[2][0] == got[3][0] == "junk" and got[4][:2] == ("remapped", "Place") and got[5][:2] == ("remapped", "Person") and got[6][0] == "dropped" and got[0][0] == "valid"


def test_structure_and_presets(spark):
    names = ["Chapter XII", "chapter one", "Section 1.2", "Part 3", "Book IV", "Appendix A", "Figure 2.1", "p. 42", "Vol. II", "Chapters", "Bookend", "Pagett"]
    e = entities(spark, *[(k, n, "Thing") for k, n in enumerate(names)], (20, "Real", "SECTION"))
    kept, rel = x.without_structure(e, relations(spark, (9, 10, "a", 0.5), (0, 9, "b", 0.5)))
    assert {g.name for g in kept.collect()} == {"Chapters", "Bookend", "Pagett"} and rel.count() == 1
    assert x.filtering("strict").max_entity_degree == 20 and x.filtering().semantic_dedup_threshold == 0.90
    assert x.filtering("lenient", {"max_entity_degree": 7, "odd": 1}, {"max_entity_degree": 8}).max_entity_degree == 8
    for bad in (lambda: x.filtering("raw"), lambda: x.filtering("strict", {"odd": 1}, strict=True), lambda: x.filtering("strict", {"extraction_filtering_mode": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_aliases_against_a_loop(spark, data):
    from graphloom import catalog

    generic = {"unknown", "thing", "entity", "item", "object", "concept", ""}
    want, per = {}, defaultdict(list)
    for e in m.mentions(spark, data).collect():
        per[e.source_id].append(e)
    for rows in per.values():
        seen = []
        for e in sorted(rows, key=lambda v: v.ordinal):
            keys = [k.strip().lower() for k in [e.name, *e.aliases]]
            kind = e.type.lower()
            hit = next((o for k in keys for n, o, t in seen if n == k and (t == kind or t in generic or kind in generic)), None)
            if hit is None:
                seen.append((keys[0], e.ordinal, kind))
            want[e.ordinal] = e.ordinal if hit is None else hit
    got = {g.ordinal: g.canonical for g in catalog.queries()["er_exact_aliases"](spark, data).collect()}
    assert got == want and any(k != v for k, v in got.items())


def test_semantic_merge_against_a_loop(spark, data):
    import numpy as np

    from graphloom import catalog

    rows = [g for g in r._vectored(spark, data).collect()]
    per = defaultdict(list)
    for g in rows:
        per[g.source_id].append(g)
    want, merges = {}, 0
    for group in per.values():
        group.sort(key=lambda v: v.ordinal)
        units = {g.ordinal: np.array(g.embedding, float) / np.linalg.norm(g.embedding) for g in group}
        taken = {}
        for i, a in enumerate(group):
            if a.ordinal in taken:
                continue
            sure = a.confidence
            for b in group[i + 1 :]:
                if b.ordinal in taken or not (a.type == b.type or ("Thing" in (a.type, b.type) and len(group) < 50)):
                    continue
                base = float(units[a.ordinal] @ units[b.ordinal])
                low = lambda v: v.lower()
                bonus = 0.2 * (low(a.name) == low(b.name)) + 0.15 * (low(a.name) in b.aliases) + 0.15 * (low(b.name) in a.aliases) + 0.1 * bool(set(a.aliases) & set(b.aliases))
                score = min(1.0, base + bonus)
                if score < 0.35 or (score <= base and score < 0.43):
                    continue
                taken[b.ordinal] = a.ordinal
                sure = max(0.1, max(sure, b.confidence) - (0.05 if score - 0.35 < 0.1 else 0))
                merges += 1
            want[a.ordinal] = (a.ordinal, round(sure, 6))
        want |= {o: (a, next(round(g.confidence, 6) for g in group if g.ordinal == o)) for o, a in taken.items()}
    got = {g.ordinal: (g.canonical, round(g.confidence, 6)) for g in catalog.queries()["er_semantic"](spark, data).collect()}
    assert got == want and merges > 20 and {len(group) >= 50 for group in per.values()} == {True, False}


def test_hierarchy_follows_chains(spark):
    e = entities(spark, (0, "Smith", "P"), (1, "Bob Smith", "P"), (2, "Bob Smith Jr", "P"), (3, "Mary", "P"), (4, "Marya", "P"), (5, "prince Smith", "Q"), (6, "Bob Smithson", "P"), (7, None, "P"), (8, "bob smith", "P"))
    got = {g.ordinal: g.canonical for g in r.hierarchical(e).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 2}


def test_hierarchy_against_a_loop(spark, data):
    from graphloom import catalog

    titles = {"mr", "mrs", "ms", "dr", "prof", "sir", "lady", "lord", "the"}
    border = lambda long, short: all(not c.isalnum() for c in (long[: long.find(short)][-1:], long[long.find(short) + len(short) :][:1]) if c)
    words = lambda name: {w for w in name.split() if len(w) > 1 and w not in titles}

    def keeps(a, b):
        """Which of two names stays: 0, 1 or none."""
        if a != b and a in b:
            return 1 if border(b, a) else None
        if a != b and b in a:
            return 0 if border(a, b) else None
        wa, wb = words(a), words(b)
        return 1 if wa <= wb and len(wa) / len(wb) >= 0.4 else 0 if wb <= wa and len(wb) / len(wa) >= 0.4 else None

    per, want = defaultdict(list), {}
    for e in m.mentions(spark, data).collect():
        per[e.source_id].append((e.ordinal, e.name.strip().lower()))
    for rows in per.values():
        rows = sorted(rows)
        into = {}
        named = [(o, n) for o, n in rows if words(n)]
        for i, (a, na) in enumerate(named):
            if a in into:
                continue
            for b, nb in named[i + 1 :]:
                if b in into or (keep := keeps(na, nb)) is None:
                    continue
                stays, goes = (a, b) if keep == 0 else (b, a)
                into[goes] = into.get(stays, stays)
        for o, _ in rows:
            end = o
            while end in into:
                end = into[end]
            want[o] = end
    got = {g.ordinal: g.canonical for g in catalog.queries()["er_hierarchical"](spark, data).collect()}
    assert got == want and sum(k != v for k, v in got.items()) > 50


def test_merge_folds_in_order(spark):
    e = entities(
        spark, (0, "Ann", "Person", {"confidence": 0.4, "description": "A woman", "chunk_index": 3}), (1, "Anna K", "Lady", {"confidence": 0.9, "aliases": ["AK"], "chunk_index": 1}), (2, "Lady", "Title", {"confidence": 0.2, "description": "Quite another thing altogether"}),
    ).withColumn("properties", F.when(F.col("ordinal") == 0, F.create_map(F.lit("age"), F.lit("30"), F.lit("bio"), F.lit("a rather long text of a life"))).otherwise(F.create_map(F.lit("age"), F.lit("31"), F.lit("bio"), F.lit("an even longer text of all of a life"))))
    canonical = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0)], "source_id bigint, ordinal bigint, canonical bigint")
    g = r.merged_entities(e, canonical, penalty=0.05).first()
    assert (g.name, g.type, g.aliases, g.source_chunk_indices, g.merged) == ("Ann", "Lady", ["AK", "Anna K"], [0, 1, 3], 3)
    assert g.confidence == pytest.approx(0.80) and g.history.confidence == [0.4, 0.2] and g.history.aliases_skipped == ["Lady"]
    assert g.properties == {"age": "31", "bio": "an even longer text of all of a life"} and g.description == "A woman. Quite another thing altogether"


def test_domains(spark):
    docs = spark.createDataFrame([(1, "class Foo is a function", "a.py", "code"), (2, "", None, None), (3, None, "b.txt", None), (4, "AI and function of a class", "b.txt", None)], "doc_id bigint, text string, filename string, doc_type string")
    code = x.Domain("code", keywords=((("class", "function", "ai"), 2.0),), patterns=((r"class [A-Z]", 1.0),), extensions=(".py",), doc_types=("code",))
    got = {g.doc_id: (g.domain, round(g.score, 6), g.low) for g in x.detected(docs, [code]).collect()}
    assert got == {1: ("code", 0.75, False), 2: ("generic", 0.1, True), 3: ("generic", 0.1, True), 4: ("generic", 0.1, True)}
    assert x.detected(docs, [code], "legal").first().score == 1.0


def test_empty_tables(spark):
    e, rel = entities(spark).limit(0), relations(spark).limit(0)
    said = spark.createDataFrame([], "source_id bigint, sentences array<string>")
    rules = spark.createDataFrame([], "name string, source_types array<string>, target_types array<string>")
    canonical = spark.createDataFrame([], "source_id bigint, ordinal bigint, canonical bigint")
    for rows in (x.entity_evidence(e, said), x.relation_evidence(rel, e, said), x.constrained(rel, e, rules), x.limited(rel, e), r.hierarchical(e), r.greedy_aliases(e), r.merged_entities(e, canonical), x.rescued_types(e, rel, ["A"], {}, {}), x.valid_relations(rel, e)):
        assert rows.count() == 0


def test_words_inside_sentences_equal_sql(spark):
    """Words in a row, single letters in a row and the SQL's own mark: each is taken, not every second one."""
    import duckdb

    texts = [(1, "went to Foo Bar Baz, Qux; Zed"), (2, "a b c d e F"), (3, "so ^Marked x ^ Caret"), (4, None), (5, "1 Two. Three")]
    found = {tuple(r) for r in x.spoken_words(spark.createDataFrame(texts, "source_id bigint, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert set(con.execute(f"WITH {x._TEXT_WORDS} SELECT source_id, word, inside FROM said").fetchall()) == found
    assert {w for k, w, inside in found if k == 1 and inside} == {"to", "Foo", "Bar", "Baz", "Qux", "Zed"}
