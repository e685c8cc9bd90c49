"""Operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from graphloom.llm import binary_output, decontaminate, embedding_dedup, language_id, line_dedup, packing, quality, secrets, simhash, substring_dedup

from graphloom.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    """Documents of the smallest tables, odd ones, and a column that clashes with an operator's."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(1000, None), (1001, ""), (1002, "   \n\t "), (1007, "² 12"), (1003, "The the the ßtraße İ Σ don't foo-bar 12³ x'y,z"), (1004, "one two three four five six seven"), (1005, "one two three four FIVE six seven"), (1006, "word " * 3000), (1008, "before <|endoftext|>after<|startoftext|> x<|EndOfText|>")]
    return spark.createDataFrame(real + odd + [odd[4], real[3]], "doc_id bigint, text string").selectExpr("*", "1 AS first", "'x' AS z", "2.0 AS score")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted([(r.doc_id, r.text or "") for r in docs.collect()])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ids_of(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert quality.quality_classifier(empty, labels).count() == 0
    for run in (secrets.secret_scan, packing.best_fit_packing, line_dedup.line_dedup, simhash.near_duplicates, binary_output.token_binary, language_id.language_id, substring_dedup.substring_dedup):
        assert run(empty).count() == 0, run
    assert decontaminate.contamination(empty, items).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_missing_labels_and_items(spark, docs):
    assert {r.score for r in quality.quality_classifier(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()} == {0.5}
    assert decontaminate.contamination(docs, spark.createDataFrame([(1, None), (2, "too short")], "item_id bigint, text string")).where("contaminated").count() == 0


def test_packing_round_trip(docs, texts):
    rows = packing.best_fit_packing(docs, with_ids=True).toPandas()
    want = {}
    for doc, text in texts:
        ids = np.append(ids_of("byte_bpe_50k.json", text), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        for piece, (a, b) in enumerate([(0, first), *[(k, k + 2048) for k in range(first, len(ids), 2048)]]):
            want.setdefault((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), 0)
            want[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = rows.groupby(["doc_id", "piece", "start", "length", "ids_crc32"]).size().to_dict()
    assert got == want
    assert all(zlib.crc32(i) == c for i, c in zip(rows["ids"], rows["ids_crc32"], strict=True))
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (ends - rows["length"] == rows["offset"]).all() and ends.max() <= 2048


def test_sum_of_squares_is_greedy():
    lengths = np.array(random.Random(1).choices(range(1, 65), k=400))
    bins, offsets = packing.sum_of_squares(lengths, 64)
    open_, n = {}, 0
    for s, bin_, offset in zip(lengths, bins, offsets, strict=True):
        cost = lambda gaps: sum(c * c for c in np.bincount([g for g in gaps if g], minlength=65)[1:])
        def moved(b):
            gaps = dict(open_)
            gaps[b] = gaps.get(b, 64) - s
            return cost(gaps.values())
        choices = [moved(b) for b, g in open_.items() if g >= s] + [moved(n)]
        assert moved(bin_) == min(choices) and offset == 64 - open_.get(bin_, 64)
        n += bin_ not in open_
        open_[bin_] = open_.get(bin_, 64) - s


def test_binary_round_trip(spark, docs, texts, tmp_path):
    rows = sorted(map(tuple, binary_output.token_binary(docs, block_ids=1000).collect()))
    at, want = 0, []
    for doc, text in sorted(texts, key=lambda x: (x[0],)):
        ids = np.append(ids_of("word_bpe_49k.json", text), 2).astype("<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows == sorted(want)
    ids = np.random.default_rng(0).integers(0, 49408, 999).astype(np.uint32)
    assert (binary_output.from_planes(binary_output.to_planes(ids, bytes), 999, bytes) == ids).all()


def test_secret_base_spans(docs, texts, spark):
    kinds = [(re.compile(secrets.ASSIGN, re.A), lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    extra = [(1, "😀 password = 'abcdefghijkl' token=short secret=token\"=\"LONGVALUE1234567"), (2, "AKIA" + "Z" * 16), (3, "client_id: foo99 then Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 at https://a.b/c"), (4, "https://alone.example/x"), (5, "client_id: foo99" + " far" * 400 + " Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9")]
    got = {(r.doc_id, r.base_sha256): r for r in secrets.secret_scan(spark.createDataFrame(extra, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))).collect()}
    for doc, text in texts + extra:
        found = sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(kinds) for m in p.finditer(text) if fits(m))
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert (doc, hashlib.sha256(written.encode()).hexdigest()) in got
    spans = {r.doc_id: r.spans for r in got.values()}
    assert spans[3] == "identifier:0:16,opaque:22:49,endpoint:53:66" and spans[4] == "" and spans[5] == ""


LONG = {
    "labels": "a." * 500_000 + "b:80",
    "letters": "q" * 1_000_000,
    "assigned": "token=abcdefghijkl1 " * 50_000,
    "weak": "client_id: foo99 Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 a.b:80 " * 20_000,
    "hosts": "a.b-c.d:8080 " * 50_000,
    "wide": "https://" + "a😀" * 200_000,
    "blanks": "password" + " " * 1_000_000,
}


def test_secrets_in_very_long_texts(spark):
    """A megabyte of labels, of one run, of matches: no depth of calls, no time by the square."""
    rows = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id bigint, text string")
    began = time.monotonic()
    got = {list(LONG)[r.doc_id]: r for r in secrets.secret_scan(rows).collect()}
    assert time.monotonic() - began < 120
    assert got["assigned"].n_assign == 50_000 and got["assigned"].spans.endswith(f"assign:{49_999 * 20}:{49_999 * 20 + 19}")
    assert got["weak"].n_linked == 60_000  # each part has a complement within the scope
    assert {k for k, r in got.items() if r.spans} == {"assigned", "weak"}


def test_weak_parts_inside_base_spans_are_no_candidates(spark):
    text = "client_id: foo99 token=Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 " + "far " * 200 + "see a.b.c:8080 or https://x.example/y"
    row = secrets.secret_scan(spark.createDataFrame([(1, text), (None, text), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.spans) for r in row) == sorted([(False, "identifier:0:16,assign:17:50"), (True, "identifier:0:16,assign:17:50"), (True, "")])


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cursor = con.execute(llm_queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    df = llm_queries.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


def test_line_dedup(docs, texts):
    seen, lost, dropped, gone = set(), {}, set(), {}
    for doc, text in sorted(set(texts), key=lambda x: (x[0], xxhash.xxh64_intdigest(x[1].encode(), 42))):
        for n, line in enumerate(text.split("\n")):
            w = tuple(WORD.findall(line))
            if len(w) < 3:
                continue
            less = [w[:i] + w[i + 1 :] for i in range(len(w))]
            near = len(w) >= 5 and (w in dropped or any((x, i) in lost for i, x in enumerate(less)) or (len(w) > 5 and any(x in seen for x in less)))
            if w in seen or near:
                gone.setdefault(doc, []).append(n)
            seen.add(w)
            if len(w) >= 5:
                lost.update({(x, i): 1 for i, x in enumerate(less)})
                dropped.update(less if len(w) > 5 else [])
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs).collect()}
    assert got == {doc: ",".join(map(str, gone.get(doc, []))) for doc, _ in texts}
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert 1005 not in kept and kept[1004] and kept[1001] == ""


def test_short_lines_are_cut(spark):
    """Equal lines of one or two words, or of a script without blanks, go like any other; empty ones stay."""
    rows = [(1, "Les.\n\n这是一个很长的句子没有空格\nfirst own line"), (2, "Wh the.\nLes.\n\n 这是一个很长的句子没有空格\nsecond own line"), (3, "Wh  the.\nthird own line"), (4, "Les.")]
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Wh the.\n\nsecond own line", 3: "third own line"}


def groups_of(ids, linked):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(docs, texts):
    def fp(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = {doc: fp(text) for doc, text in texts}
    want = groups_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) and all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


def test_embedding_lower_bounds_hamming(spark):
    pairs = [(random.getrandbits(64) - (1 << 63), random.getrandbits(64) - (1 << 63)) for _ in range(200)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = df.select("a", "b", F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b")))).alias("low")).collect()
    for r in rows:
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        manhattan = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert r.low == manhattan <= (a ^ b).bit_count()


def test_similar_groups(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(20)]
    rows = []
    for k, words in enumerate(base):
        near = list(words)
        near[60] = "changed"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(words))]
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == {i: i // 3 * 3 for i in range(60)}
    assert simhash.keep_first(df).count() == 22


def test_similar_groups_at_the_similarity(spark):
    """Pairs just above a Jaccard similarity of 0.8 are found as often as pairs at it are promised to be, and none below it."""
    rng = random.Random(11)
    rows, alike = [], {}
    for k in range(600):
        n = rng.randrange(60, 400)
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        near = list(words)
        for i in rng.sample(range(n), max(1, round(n * rng.uniform(0.016, 0.03)))):
            near[i] = f"x{k}"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, near))
        alike[2 * k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = [k for k, j in alike.items() if 0.8 <= j < 0.85]
    assert len(at) > 150
    assert sum(got.get(k + 1) == k for k in at) >= 0.95 * len(at)
    assert not any(k in got for k, j in alike.items() if j < 0.8)


def test_first_of_linked_fingerprints_stays(spark):
    """What fingerprints link goes though its sets of shingles are less alike than the rest of the stage asks for."""
    rng = random.Random(5)
    linked = None
    while linked is None:
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(40, 120))]
        near = [*words]
        for i in rng.sample(range(len(near)), 4):
            near[i] = f"x{rng.randrange(1000)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, near))
        bits = (simhash.fingerprint(" ".join(words), 4) ^ simhash.fingerprint(" ".join(near), 4)) & (1 << 64) - 1
        if len(a & b) < 0.75 * len(a | b) and bits.bit_count() <= 4:
            linked = [(1, " ".join(words)), (2, " ".join(near)), (3, "Words of a text that nobody else here has said so far at all")]
    df = spark.createDataFrame(linked, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 3]


def test_substring_dedup(docs, texts):
    unique = sorted(set(texts), key=lambda x: (x[0], 0))
    seen, want = {}, {}
    for doc, text in unique:
        words = WORD.findall(text)
        covered = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                covered[i : i + 20] = True
            seen[key] = 1
        kept = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        want[doc] = (len(words), int(covered.sum()), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(texts) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_decontamination(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    words = items[0][1].split()
    third = len(words) // 3
    moved = " ".join([*words[2 * third :], "between", "them", *words[:third], "and", *words[third : 2 * third]])
    spaced = "人工智能的历史可以追溯到上个世纪"
    rows = [(1, "intro " + items[1][1].upper() + "!!"), (2, moved), (3, " ".join(words[:third])), (4, None), (5, ""), (6, "quite other text " * 30), (7, f"前言{spaced}。")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "2 AS t", "'x' AS words")
    bench = spark.createDataFrame(items + [items[1], (None, items[2][1]), (9000, None), (9001, "too short"), (9002, spaced)], "item_id bigint, text string")
    for bits in (1 << 27, 1 << 15):
        got = {r.doc_id: r.item_ids for r in decontaminate.contamination(df, bench, most_bits=bits).collect()}
        assert got == {1: str(items[1][0]), 2: str(items[0][0]), 3: "", 4: "", 5: "", 6: "", 7: "9002"}


def tiled_by_brute_force(item, text, least):
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and free_i[i + k] and free_t[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            free_i[best[0] + k] = free_t[best[1] + k] = False


def test_greedy_tiles_against_brute_force():
    rng = random.Random(5)
    for round_ in range(80):
        item, text = rng.choices(range(1, 4 + round_ % 3), k=rng.randrange(5, 60)), rng.choices(range(1, 4 + round_ % 3), k=rng.randrange(5, 90))
        got = decontaminate.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert got == tiled_by_brute_force(item, text, 3)


def test_coverage_against_brute_force(spark):
    """Documents made of shuffled, cut and doubled parts of items: the share of each item under tiles, and so each pair."""
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(4, 30)))) for k in range(12)]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(items)[1].split()
            a = rng.randrange(len(words))
            parts.append(words[a : a + rng.randrange(4, 30)] if rng.random() < 0.5 else words)
        rng.shuffle(parts)
        docs.append((d, " ".join(w for p in parts for w in [*p, *rng.choices(["x", "y", "w1"], k=rng.randrange(3))])))
    want = {}
    for d, text in docs:
        shares = {k: sum(n for _, _, n in tiled_by_brute_force(i.split(), text.split(), 5)) / len(i.split()) for k, i in items}
        held = sorted(k for k, share in shares.items() if share >= 0.8)
        want[d] = (",".join(map(str, held)), max((shares[k] for k in held), default=0.0))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.item_ids, r.max_coverage) for r in got} == want
    assert len({v for v, _ in want.values()}) > 10


def test_tiles_of_periodic_and_long_texts():
    item = np.array([7] * 50, np.uint64)
    assert sum(k for _, _, k in decontaminate.greedy_tiles(item, np.full(300_000, 7, np.uint64), 5)) == 50
    long = np.random.default_rng(2).integers(1, 1 << 40, 60_000).astype(np.uint64)
    assert decontaminate.greedy_tiles(long, np.concatenate([long[30_000:], long[:30_000]]), 5) == [(0, 30_000, 30_000), (30_000, 0, 30_000)]


def test_removals_by_row(spark, data):
    """Ids on several texts, equal rows and null ids: each row is judged as itself."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 150").first()
    bench = spark.createDataFrame([(item.item_id, item.text)], "item_id bigint, text string")
    clean = "A clean text that shares nothing with any of the others here at all"
    rows = spark.createDataFrame([(1, item.text), (1, clean), (None, item.text), (None, "Other words than those that nobody else here has said so far at all"), (5, clean), (5, clean), (6, None)], "doc_id bigint, text string").selectExpr("*", "3 AS _gone_id", "4 AS first")
    assert sorted(map(str, ((r.doc_id, r.text) for r in decontaminate.keep_clean(rows, bench).collect()))) == sorted(map(str, [(1, clean), (None, "Other words than those that nobody else here has said so far at all"), (5, clean), (5, clean), (6, None)]))
    kept = simhash.keep_first(rows).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, item.text), (1, clean), (None, "Other words than those that nobody else here has said so far at all"), (6, None)]))
    learnt = rows.selectExpr("*", "'en' AS lang")
    assert sorted(str(r.doc_id) for r in language_id.keep_known(learnt).collect()) == ["1", "1", "5", "5", "None", "None"]


def test_language_and_quality_on_held_out(spark):
    data = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = language_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.quality_classifier(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_language_scores_against_plain_bayes(spark):
    """Counts, priors and posteriors in plain Python; n-grams are told apart by bucket as the operator does."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(7001, "İSTANBUL\u3000x", "tr"), (7002, "ab", None)]
    def grams(text):
        chars = " ".join(["", *text.lower().split(), ""])
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = 0
                for k, c in enumerate(chars[i : i + n]):
                    h = (h * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(c) + k + 1)
                yield (h * 0x85EBCA6B & 0xFFFFFFFF) >> 18
    counts, seen = {}, collections.Counter()
    for doc, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts.setdefault(lang, collections.Counter()).update(grams(text))
            seen[lang] += 1
    langs = sorted(counts)
    size = {lang: sum(counts[lang].values()) + 0.5 * (1 << 14) for lang in langs}
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    for doc, text, _ in docs[::7] + docs[-2:]:
        if not any(map(str.isalpha, text or "")):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        every = list(grams(text))
        prior = {lang: math.log(seen[lang] / sum(seen.values())) for lang in langs}
        sums = {lang: sum(math.log((counts[lang][g] + 0.5) / size[lang]) for g in every) for lang in langs}
        best = max(langs, key=lambda lang: sums[lang] + prior[lang])
        fair = {lang: prior[lang] + sums[lang] * min(len(every), 100) / len(every) for lang in langs}
        assert got[doc].lang_pred == best
        assert got[doc].score == pytest.approx(1 / sum(math.exp(fair[lang] - fair[best]) for lang in langs), rel=1e-6)


def test_language_of_odd_texts(docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(docs.selectExpr("*", "'en' AS lang")).collect()}
    assert got[1000] == got[1001] == got[1002] == got[1007] == ("und", 0.0) and got[1003][0] == "en"


def test_machine_identity():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, value = rng.choice(50, 12, replace=False), rng.normal(size=12)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    assert machine.margins(at, value, np.array([0]))[0] == pytest.approx(0.3 + machine.weights[at] @ value + pairs)


def test_scores_against_all_pairs(spark, data):
    """Scores of a fitted machine, in plain Python: bias, weights and every pair of features one by one."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text", "n_chars").collect()
    machine = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    odd = [(9001, None, None), (9002, "", 0), (9003, "  \n ", None), (9004, "word " * 400, 2000)]
    df = spark.createDataFrame([tuple(r) for r in rows[:25]] + odd, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in quality.score(df, machine).collect()}
    for doc, text, n in [tuple(r) for r in rows[:25]] + odd:
        words = (text or "").split()
        share = collections.Counter(words)
        found = [(xxhash.xxh64_intdigest(w.encode(), 7) % (1 << 16), math.sqrt(k / len(words))) for w, k in share.items()]
        for k, v in enumerate(quality.statistics(text or "", n, words, share)):
            found.append(((1 << 16) + 16 * k + min(15, int(v * 16)), 0.5))
        margin = machine.bias + sum(machine.weights[i] * v for i, v in found)
        if len(found) < 250:
            margin += sum(float(machine.factors[i] @ machine.factors[j]) * a * b for k, (i, a) in enumerate(found) for j, b in found[:k])
            assert got[doc].score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
            assert got[doc].predicted == int(got[doc].score >= 0.3)
        assert 0 <= got[doc].score <= 1 and got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([centres, centres + 0.2 * rng.normal(size=centres.shape), centres[:5], centres[:5]])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [1.0, 0.0]), rows[0]]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    units = np.array([r[1] for r in rows[:130]] + [rows[0][1]], np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    ids = [*range(130), 0]
    near = units @ units.T >= 0.9
    want = groups_of(range(130), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if ids[a] != ids[b]])
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * (near.sum() - len(near)) and found <= near.sum() - len(near)
    assert all(r.component_id == (want[r.vec_id] if r.vec_id < 900 else r.vec_id) for r in got)


def test_recall_at_the_threshold(spark):
    """3,000 pairs at a cosine of 0.90 to 0.92 among 8,000 vectors; the same links whatever the size of a tile."""
    rng = np.random.default_rng(9)
    n, size = 3000, 64
    u, v = rng.normal(size=(n, size)), rng.normal(size=(n, size))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(axis=1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.92, (n, 1))
    x = np.concatenate([u, c * u + np.sqrt(1 - c * c) * v, rng.normal(size=(2000, size))])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})).repartition(4).cache()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    found = [i for i in range(n) if got[i][0] == 1 and got[n + i] == (1, i)]
    assert len(found) >= 0.94 * n
    assert sum(k for k, _ in got.values()) == 2 * len(found)  # no other pair is that near
    tiled = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, tile=100).collect()}
    assert tiled == got


def test_one_dense_cell(spark):
    """Most vectors lie in one cell, which is cut into slots and tiles: every pair is still met once."""
    rng = np.random.default_rng(10)
    centre = rng.normal(size=32)
    x = centre + 0.3 * rng.normal(size=(700, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    units = x / np.linalg.norm(x, axis=1)[:, None]
    near = (units @ units.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, tile=64).collect()}
    assert all(got[i] <= near[i] for i in got) and sum(got.values()) >= 0.94 * near.sum()


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_fingerprints_of_all_cells_are_not_broadcast(spark):
    """Spark sizes rows that it explodes by the file they come from; their join is by sort and merge at any size."""
    fps = spark.createDataFrame([(random.getrandbits(63),) for _ in range(200)], "fp bigint")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_exploded_tables_are_not_broadcast(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, 2, [5, 6])], "item bigint, n bigint, seeds array<bigint>")
    scanned = spark.createDataFrame([(7, [5, 6, 8])], "row bigint, seeds array<bigint>")
    assert "strategy=merge" in decontaminate._candidates(scanned, items, 1, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    written = {}
    for module in (simhash, line_dedup):
        plain = module.materialise_at
        monkeypatch.setattr(module, "materialise_at", lambda df, tag, plain=plain: (written.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, tag))[1])
    simhash.similar_groups(docs, max_bits=4)
    line_dedup.removed_lines(docs).count()
    for tag in ("shared", "mixed", "rest", "wanted"):
        assert all("strategy=merge" in p for p in written[tag]), tag
