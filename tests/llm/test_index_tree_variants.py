"""Digest index, Merkle manifest and spelling variants against plain Python, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import encoding, exact_dedup, merkle, quality, variants
from graphloom.plans.scratch import materialise, scratch_path

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, " \n\t ", "en", None, 5), (2003, " ", "en", "", 1), (2004, "two  words\x0bhere", None, "é", 3),
    (2005, "two words here", "xx", "b", None), (None, "two words here", "xx", "b", 3), (None, "alone\nwithout an id", None, "b", 1), (2006, "a b c" * 40_000, "en", "b", 2),
]


@pytest.fixture(scope="module")
def rows(spark, data):
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return real + ODD + [ODD[0], ODD[5], real[7], real[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 AS digest", "'x' AS leaf", "2.0 AS word", "3 AS g", "4 AS block", "5 AS keep_id", "6 AS d", "7 AS i", "8 AS n", "9 AS task")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- digest index ---------------------------------------------------------------------------


def copies(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row, as often as it occurs."""
    groups = collections.defaultdict(list)
    for doc, text, *_ in rows:
        groups[sha(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""))].append(doc)
    out = collections.Counter()
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        ids.sort(key=lambda i: (i != keep,))
        for k, doc in enumerate(ids):
            out[doc, keep, len(ids), k == 0, digest] += 1
    return out


def test_copies(docs, rows):
    assert collections.Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == copies(rows)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_very_large_group_of_copies(spark):
    """A text in a third of the rows: its class is broadcast, its rows aren't moved."""
    many = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 1 THEN 'the same  text' ELSE concat('text ', id) END AS text")
    got = exact_dedup.exact_dedup(many)
    assert got.where("group_size = 20000 AND keep_id = 1").count() == 20_000 and got.where("kept").count() == 40_001


def test_index_outlives_sessions_and_retries(spark):
    """New texts are appended once, into the same buckets; the index side of the anti-join is not shuffled."""
    path = scratch_path(spark, "index")
    first = exact_dedup.digested(spark.createDataFrame([(5, "a"), (3, "a"), (9, "b"), (None, "c")], "doc_id bigint, text string"))
    index = exact_dedup.DigestIndex(spark, path, 4)
    for _ in range(2):  # a batch taken in again changes nothing
        index.add(first)
    index.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    later = spark.createDataFrame([(1, "a"), (2, "d"), (4, "d"), (7, "c")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(later, again).collect()}
    assert got == {1: (3, False), 2: (2, True), 4: (2, False), 7: (None, False)}  # what was known first stays
    assert sorted((r.digest.hex(), r.doc_id) for r in again.table().collect()) == sorted([(sha("a"), 3), (sha("b"), 9), (sha("c"), None), (sha("d"), 2)], key=lambda x: x[0])
    heads = exact_dedup.digested(later).groupBy("digest").count()
    plan = heads.join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
    again.close()


# ---- Merkle manifest ------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc, text, lang, source, n):
    return sha("".join(map(field, (doc, source, lang, n, text))))


def climb(nodes):
    """The root of a list of digests and each one's siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = at[k] - at[k] % 3
            paths[k].append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 3])))
            at[k] //= 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return (nodes[0] if nodes else None), paths


def proofs(rows):
    per = collections.defaultdict(list)
    for doc, text, lang, source, n in rows:
        told = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None
        per[source].append(((doc is not None, doc or 0), leaf_of(doc, text, lang, source, n), doc, leaf_of(doc, text.replace("\n", "") if told else text, lang, source, n)))
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        per[source].sort(key=lambda x: x[:2])
        trees[source] = climb([x[1] for x in per[source]])
    root, tops = climb([trees[s][0] for s in order])
    out = collections.Counter()
    for source, top in zip(order, tops, strict=True):
        subroot, paths = trees[source]
        for (_, leaf, doc, told), path in zip(per[source], paths, strict=True):
            path = path + top
            now = told
            for left, right in path:
                now = sha(left + now + right)
            out[doc, leaf, subroot, root, sha("".join(a + b for a, b in path)), now, now == root] += 1
    return out


def test_proofs(docs, rows):
    got = merkle.merkle_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == proofs(rows)
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0
    assert merkle.merkle_manifest(docs.where("doc_id = 2003")).first()[1:] == tuple(next(iter(proofs([ODD[3]]))))[1:]


def test_trees_of_several_rounds(spark):
    """A source larger than a block, and more sources than a block has nodes."""
    big = [(k, f"line {k}\nand more" if k % 5 else None, None, "big" if k % 3 else None, k) for k in range(2500)]
    many = [(5000 + k, f"t\n{k}", "en", f"s{k}", 1) for k in range(800)]
    table = spark.createDataFrame(big + many, DOCUMENT).repartition(7)
    assert collections.Counter(map(tuple, merkle.merkle_manifest(table).collect())) == proofs(big + many)


# ---- spelling variants ----------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def grouped(rows):
    n = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants(spark):
    random.seed(4)
    stems = ["receive", "accommodate", "necessary", "naïveté", "straßenbahn", "ÀÀÀÀÀÀÀ", "aaaaaaa", "q" * 5000]
    texts = []
    for stem in stems:
        texts += [stem] * 130
        for _ in range(60):
            k, c = random.randrange(len(stem) + 1), random.choice("abeßé")
            bad = random.choice([stem[:k] + c + stem[k:], stem[:k] + c + stem[k + 1 :], stem[:k] + stem[k + 1 :]])
            texts += [bad] * random.choice([1, 2, 3, 14])
            k = random.randrange(len(bad))
            texts += [bad[:k] + random.choice("abeé") + bad[k + 1 :]] * 2
    table = [(k, f"{x.upper() if k % 9 == 0 else x}, {x}! {texts[-k]}9x") for k, x in enumerate(texts)] + [(None, "Receive receive"), (7777, None), (7778, ""), (7779, "Kurz ab")]
    table += [table[0]] * 3
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(spark.createDataFrame(table, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n", "'k' AS key")).collect()}
    want = grouped(table)
    assert got == want and any(f and r != f for f, r, *_ in want.values()) and max(v[3] for v in want.values()) > 20


def test_pairs_are_all_pairs(spark):
    """All words over two letters of lengths 7 to 9, and sampled ones over more: no pair is lost, none is false."""
    words = ["".join(w) for n in (7, 8) for w in itertools.product("ab", repeat=n)] + ["".join(random.Random(k).choices("abcé", k=random.Random(-k).randint(7, 10))) for k in range(300)]
    words = sorted(set(words))
    got = {(min(r), max(r)) for r in map(tuple, variants.near_pairs(materialise(spark.createDataFrame([(w,) for w in words], "word string"), "w")).collect())}
    assert got == {(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}


def test_no_words(spark):
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id bigint, text string")).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- token ids ------------------------------------------------------------------------------

MARKED = ["😀<|ENDOFTEXT|>", "中<|EndOfText|>", "<|StartOfText|>x", "é<|ENDOFTEXT|>BAR"]
PARTS = [*MARKED, "<|endoftext|>", "a", "B", " ", "\n", "1", "²", "'S", "İ", "Σ", "ß", "BAR", "<|", "|>", "ENDOFTEXT", "ſ", "한"]


@pytest.mark.parametrize(("name", "keep_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_around_added_tokens(name, keep_space):
    """Added tokens in capitals after characters of any class: the ids are the library's."""
    path, pick = public_tokenizers.path(name), random.Random(5)
    mine, theirs = encoding.Encoder(path, keep_space), Tokenizer.from_file(path)
    for text in MARKED + ["".join(pick.choices(PARTS, k=pick.randint(1, 9))) for _ in range(5000)]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id on thousands of rows teaches once, whatever other columns are called."""
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('text ', id % 3) AS text", "1 AS label", "2 AS at", "3 AS value").unionByName(spark.range(20).selectExpr("100 + id AS doc_id", "'other words' AS text", "1 AS label", "2 AS at", "3 AS value"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality").distinct()
    seen = []
    monkeypatch.setattr(quality.Machine, "fit", classmethod(lambda cls, pairs, values: seen.append((len(pairs), len(values)))))
    quality.train(docs, labels, 2)
    quality.train(docs, labels)
    assert seen[0] == (2, 2) and 2 < seen[1][0] <= 21
