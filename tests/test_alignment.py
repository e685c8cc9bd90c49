"""Places of chunks: every step on its own, and over all documents by what was done to their texts."""

import random

from graphloom import catalog
from graphloom.functions import alignment as al


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
    return row[-1]


def test_common_subsequence():
    pick = random.Random(1)
    for _ in range(200):
        a, b = ("".join(pick.choices("abcé", k=pick.randint(0, 30))) for _ in "ab")
        assert al.common(a, b) == longest(a, b)


def test_steps():
    text = "Intro.\r\n\r\nThe  first part has\r\n words in it, quite a few of them, and goes on.\r\nPAGE 7\r\nIt ends only here, after the page, with more words than before."
    found = al.aligned(text, ["Intro.", "The first part has words in it,", "The first part has words in it, quite a few of them, and goes on. It ends only here, after the page, with more words than before.", "x" * 50, "", None, "   "])
    assert found[0] == (0, 6, "exact", "exact")
    assert text[found[1][0] : found[1][1]] == "The  first part has\r\n words in it," and found[1][2:] == ("fuzzy", "spaces")
    assert text[found[2][0] : found[2][1]].startswith("The  first") and found[2][1] == len(text) and found[2][2:] == ("fuzzy", "anchors")
    assert found[3:] == [(None, None, "none", "none")] * 4
    changed = "the quick brown fox jumps over the lazy dog and then the dog sleeps a while in the sun"
    start, end, method, step = al.aligned("Before it. " * 9 + changed + " After it." * 9, [changed.replace("q", "k").replace("w", "vv").replace("z", "s")])[0]
    assert (method, step) == ("fuzzy", "window") and abs(start - 99) <= al._BAND // 4 and abs(end - 99 - len(changed)) <= al._BAND // 2
    assert al.aligned(None, ["a"]) == [(None, None, "none", "none")]


def test_repeated_chunks_follow_each_other():
    assert [f[0] for f in al.aligned("ab ab ab", ["ab", "ab", "ab", "ab"])] == [0, 3, 6, 0]
    assert [f[0] for f in al.aligned("a\tb a\tb", ["a b", "a b"])] == [0, 4]


def test_unknown_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    chunks = spark.createDataFrame([(1, 1, "two"), (1, 0, "one"), (2, 0, "x"), (3, 0, "y"), (1, 2, None)], "doc_id bigint, chunk_index int, content string")
    got = sorted((r.doc_id, r.chunk_index, r.char_start, r.method) for r in al.chunk_offsets(docs, chunks).collect())
    assert got == [(1, 0, 0, "exact"), (1, 1, 4, "exact"), (1, 2, None, "none"), (2, 0, None, "none"), (3, 0, None, "none")]


def test_all_documents_by_their_change(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").collect()}
    rows = catalog.queries()["chunk_offsets_changed"](spark, data).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == sum(-(-len(t) // 400) for t in texts.values())
    steps = {(r.doc_id % 4, r.step) for r in rows}
    assert steps >= {(0, "exact"), (0, "spaces"), (1, "anchors"), (2, "window"), (3, "none")}
    squeeze = lambda t: " ".join(t.split())
    for r in rows:
        chunk = texts[r.doc_id][400 * r.chunk_index : 400 * r.chunk_index + 400]
        if r.doc_id % 4 == 0:  # only white space differs: the span is the chunk
            original = texts[r.doc_id].replace("\n", " \r\n\t")
            assert r.method != "none" or not chunk.strip()
            assert r.char_start is None or squeeze(original[r.char_start : r.char_end]) == squeeze(chunk)
        elif r.doc_id % 4 == 2 and len(squeeze(chunk)) > 100 and r.step == "window":  # one letter in ten differs
            assert r.char_end - r.char_start >= len(squeeze(chunk))
    large = [r for r in rows if r.doc_id % 4 == 2 and len(squeeze(texts[r.doc_id][400 * r.chunk_index : 400 * r.chunk_index + 400])) > 200]
    near = [r for r in large if r.char_start is not None and abs(r.char_start - 400 * r.chunk_index) <= 32]
    assert len(near) > 0.9 * len(large)


def test_windows_that_cannot_be_alike_are_left_out(monkeypatch):
    """Of eight bands of eight windows each those are compared that those before don't rule out, and none to its end that can't be alike."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    text = " ".join(rng.choices(words, k=4000))
    calls, plain = [], al.common
    monkeypatch.setattr(al, "common", lambda *a: calls.append(a) or plain(*a))
    changed = "".join("~" if k % 10 == 9 else c for k, c in enumerate(text[5000:5400]))
    assert al.aligned(text, [text[400:0:-1], changed])[0][2] == "none" and len(calls) <= 24
    calls.clear()
    assert al.aligned(text, [changed])[0] == (5000, 5400, "fuzzy", "window")
    assert len(calls) <= 24 and plain("abcd" * 50, "wxyz" * 50, None, 160) < 160


def test_white_space_collapses_as_split_takes_it():
    for text in ("", "  ", "a", " a\t\n b ", "a 　b\x1c\x85c\ud800 ", " x  y", "no​break z\n\n"):
        got = al.Original(text)
        assert got.flat == " ".join(text.split()) and len(got.places) == len(got.flat)
        assert all(text[p] == c or (c == " " and text[p].isspace()) for p, c in zip(got.places, got.flat, strict=True))
        assert all(c != " " or not text[p - 1].isspace() for p, c in zip(got.places, got.flat, strict=True))


def test_bands_that_cannot_be_more_like_are_not_compared(monkeypatch):
    """One comparison of the whole stretch stands for a band's windows, once a better one is known."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
    text = " ".join(rng.choices(words, k=3000))
    part = "".join("~" if k % 12 == 11 else c for k, c in enumerate(text[6000:6400]))
    calls, plain = [], al.common
    monkeypatch.setattr(al, "common", lambda *a: calls.append(1) or plain(*a))
    assert al.Original(text).like(part, 0) == (6000, 6400)
    assert len(calls) < 18
