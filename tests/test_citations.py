"""Citation marks: each repair on its own, and all of them over answers made from the documents."""

import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import citations as c

A, B = "chunk_00000000aaaa", "chunk_00000000bbbb"
FIRST = "Prince Andrei rode out at dawn with his regiment. The fields were white with frost and nobody spoke a word."
SECOND = "Natasha sang in the hall until the candles went out. Everybody who heard her fell silent at the third verse."


@pytest.fixture(scope="module")
def given(spark):
    rows = [(1, "C0", A, 0, "war.txt", FIRST, [(0, 49), (50, 200)]), (1, "c1", B, 1, None, SECOND, [(0, 52), (53, 200)]), (2, "C0", B, 3, "other.txt", SECOND, None), (3, None, A, None, "x", None, None)]
    return spark.createDataFrame(rows, "answer_id bigint, alias string, chunk_id string, chunk_index int, filename string, content string, sentence_offsets array<struct<start:int,end:int>>")


@pytest.fixture(scope="module")
def run(spark, given):
    def go(step, text, answer=1):
        rows = spark.createDataFrame([(answer, text), (77, text)], "answer_id bigint, text string")
        return {r.answer_id: r.text for r in (step(rows, given) if step is not c.without_malformed else step(rows)).collect()}[answer]

    return go


def test_written_one_way(run):
    cases = {
        "See [CHUNK C0] and [chunk c1 | my file].": f"See [[cite:{A}:S1|source]] and [[cite:{B}:S1|my file]].",
        "(Chunk C0, Sentences S1, s2) (Chunk C0 Sentence S3)": f"[[cite:{A}:S1,S2|source]] [[cite:{A}:S3|source]]",
        "(C0) (C0, C1) (C0, C9)": f"[[cite:{A}:S1|war.txt]] [[cite:{A}:S1|war.txt]][[cite:{B}:S1|source]] (C0, C9)",
        "x [[cite:C0:S15,C1|f]]  y": f"x [[cite:{A}:S15|f]][[cite:{B}:S1|f]] y",
        "x [[cite:O5,C9:S1|f]] .": "x.",
        "[[cite:C1#s2]] [[cite:c0:S1;S2|lab]]": f"[[cite:{B}:s2|source]] [[cite:{A}:S1;S2|lab]]",
        f"kept [[cite:{A}:S1]]  as  is": f"kept [[cite:{A}:S1]]  as  is",
    }
    assert {k: run(c.normalised, k) for k in cases} == cases
    assert run(c.normalised, "(C0) [[cite:C4:S1|f]]", 3) == "(C0) [[cite:C4:S1|f]]" and run(c.normalised, None) == ""


def test_what_cannot_be_read_goes(run):
    assert run(c.without_malformed, f"a [[cite:C0:S1|f]] b [[cite:nope]] , c [[cite:{A}:S1|f]]") == f"a b, c [[cite:{A}:S1|f]]"
    assert run(c.without_malformed, "  indented  text") == "  indented  text"


def test_blocks(run):
    wrong = f"> {FIRST[:70]} [[cite:{B}:S1|f]]\nnext"
    assert run(c.corrected, wrong) == f"> {FIRST[:70]} [[cite:{A}:S1|war.txt]]\nnext"
    right = f"> {FIRST[:70]} [[cite:{A}:S9|f]]"
    assert run(c.corrected, right) == right and run(c.corrected, f"> {FIRST[:20]} [[cite:{B}:S1]]") == f"> {FIRST[:20]} [[cite:{B}:S1]]"
    assert run(c.corrected, wrong, 2) == wrong
    two = f'Intro\n> "{SECOND[53:]}"\n>\n\nand\n> {FIRST[:60]}\n[[cite:{A}:S1]]'
    assert run(c.blocks_cited, two) == f'Intro\n> "{SECOND[53:]}"\n> [[cite:{B}:S2|source]]\n\nand\n> {FIRST[:60]}\n[[cite:{A}:S1]]'


def test_paragraphs(run):
    text = f'He read "nobody spoke a word," aloud.\n\nAs «{SECOND[:20]}» shows\n \n> "{FIRST[:60]}"\n\n"too short" and "not in any chunk at all"'
    assert run(c.paragraphs_cited, text) == f'He read "nobody spoke a word," aloud [[cite:{A}:S2|war.txt]].\n\nAs «{SECOND[:20]}» shows [[cite:{B}:S1|source]]\n \n> "{FIRST[:60]}"\n\n"too short" and "not in any chunk at all"'


def test_marks_move_home(run):
    a, b = f"[[cite:{A}:S1|a]]", f"[[cite:{B}:S1|b]]"
    text = f'He rode "At Dawn," they say.\n\nShe sang "until the candles" went.\n\n{b}\n\nNothing. {a}'
    assert run(c.relocated, text) == f'He rode "At Dawn," they say {a}.\n\nShe sang "until the candles" went {b}.\n\nNothing. '
    stays = f'"at dawn" {a}\n\n{b}'
    assert run(c.relocated, stays) == stays


def test_all_repairs_over_documents(spark, data):
    given = {}
    for r in c._retrieved(spark, data).collect():
        given.setdefault(r.answer_id, {})[r.chunk_index] = r
    answers = {r.answer_id: r.text for r in c._answers(spark, data).collect()}
    got = {r.answer_id: r.text for r in catalog.queries()["citation_family"](spark, data).collect()}
    assert set(got) == set(answers) and len(got) > 100
    for k, text in got.items():
        g = given[k]
        mark = lambda n, s="S1", label=None: f"[[cite:{g[n].chunk_id}:{s}|{label or g[n].filename}]]"  # noqa: B023, E731
        kind = k % 6
        if kind == 0:
            assert text == f"Seen {mark(1, 'S1', 'my file')} and {mark(2, 'S1,S3', 'source')} or {mark(0)}{mark(2)} but (C0, C9)."
        elif kind == 1:
            assert text == f"It is so {mark(0, 'S2', 'lab')}{mark(1, 'S4', 'lab')} and so there."
        elif kind == 3:
            found = text.removeprefix(answers[k].split("\n\n")[0]).removesuffix("\n\nNothing more.")
            first = min(n for n in g if g[2].content[:60].strip() in g[n].content)
            assert found.startswith(f" [[cite:{g[first].chunk_id}:S") if len(g[2].content[:80].strip()) >= 40 else True
        elif kind == 5:
            paragraphs = text.split("\n\n")
            assert len(paragraphs) == 3 and paragraphs[0].startswith('First "' + g[0].content[4:34]) and f"[[cite:{g[0].chunk_id}:S1|a]]" in paragraphs[0]
            assert f"[[cite:{g[2].chunk_id}:S1|b]]" in text and "[[cite:" in paragraphs[1] and paragraphs[2].strip() == "End"
    assert sum("[[cite:" in t for t in got.values()) > 0.8 * len(got)
