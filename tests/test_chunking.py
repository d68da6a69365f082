import hashlib
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking as G
from corpusloom.operators import structure as X


def spans(spark, text, make=G.sliding_spans):
    return [(s.start, s.stop) for s in spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("s")).collect()[0].s]


@pytest.mark.parametrize("text", ["a " * 100 + ". " + "b " * 1200, "x" * 5000, "palavra " * 900, "Frase. " * 700])
def test_windows_cover_and_advance(spark, text):
    text = text.strip()
    s = spans(spark, text)
    assert s[0][0] == 0 and s[-1][1] == len(text)
    for (a, b), (c, d) in zip(s, s[1:]):
        assert a < c <= b and d > b and c - a >= 300 and b - a <= 1200


def test_short_and_empty_texts(spark):
    assert spans(spark, "curto") == [(0, 5)] and spans(spark, "") == []


def test_small_tail_joins_the_window_before(spark):
    text = "palavra " * 152
    parts = spark.createDataFrame([(text.strip(),)], "t string").select(G.sliding_chunks(F.col("t")).alias("c")).collect()[0].c
    assert len(parts) == 1 and len(parts[0]) > 1200


def test_separators_in_order_of_strength(spark):
    text = "a" * 600 + "\n\n" + "b. " * 200 + "c" * 900
    s = spans(spark, text, lambda c: G.separator_spans(c, 1000, 100))
    assert s[0] == (0, 602) and s[-1][1] == len(text)


def test_merge_small_and_legal_units(spark):
    df = spark.createDataFrame([(["a" * 400, "b", "c" * 350],)], "p array<string>")
    assert [len(x) for x in df.select(G.merge_small(F.col("p")).alias("m")).collect()[0].m] == [402, 350]
    law = "\n".join(f"Art. {i} texto" for i in range(1, 6))
    df = spark.createDataFrame([("Lei\n" + law,), ("Art. 1 só",)], "t string")
    got = [r.u for r in df.select(G.legal_units(F.col("t")).alias("u")).collect()]
    assert got[0] == ["Lei", *law.split("\n")] and got[1] is None


def test_children_lie_in_their_parents(spark):
    rows = spark.createDataFrame([(1, "Uma frase aqui. " * 600), (2, None), (3, "")], "k int, t string")
    out = G.parent_child(rows, "k", "t").collect()
    assert {r.key for r in out} == {1} and max(len(r.child) for r in out) <= 400 and len({r.parent_no for r in out}) > 2


def test_rejoined_windows_give_the_text(spark):
    text = " ".join(f"palavra{i}" for i in range(700))
    df = spark.createDataFrame([(text,)], "t string")
    parts = F.transform(G.sliding_spans(F.col("t")), lambda s: F.substring(F.col("t"), s["start"] + 1, s["stop"] - s["start"]))
    assert df.select(G.rejoin(parts).alias("x")).collect()[0].x == text


def test_semantic_chunks_break_at_turns(spark):
    rows = [(1, i, 200, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)]
    out = G.semantic_breaks(spark.createDataFrame(rows, "key int, pos bigint, chars int, vector array<double>"), share=0.1).orderBy("pos").collect()
    assert len({r.chunk for r in out}) == 1 or out[4].chunk != out[5].chunk


def test_neutral_windows_end_at_sentences(spark):
    text = "Uma frase de teste qualquer. " * 400
    out = G.neutral_windows(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    clean = text.strip()
    assert out and all(r.stop == len(clean) or clean[r.stop - 2] == "." for r in out)
    offset = int(hashlib.md5(b"0|1").hexdigest()[:7], 16) % 2_600
    ends = [0, *(i + 2 for i, c in enumerate(clean[:-1]) if c == "."), len(clean)]
    near = lambda x: min(ends, key=lambda e: (abs(e - x), e))
    want = {(near(a), near(min(a + 2_600, len(clean)))) for a in range(offset, len(clean) + 1, 2_600)}
    assert {(r.start, r.stop) for r in out} == {w for w in want if w[1] > w[0]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["heading", "text", "table"]), st.text(alphabet="ab. ", min_size=1, max_size=600)), max_size=12))
def test_packing_keeps_all_text(units):
    packed = X.pack_page([k for k, _ in units], [t for _, t in units], [None] * len(units))
    joined = "".join("".join(t for t, _ in packed).replace("[/TABELA]", "").split())
    assert joined == "".join("".join(t for _, t in units).split())
    assert all(len(t) >= 300 for t, _ in packed[:-1]) or len(packed) == 1


def test_table_rows_repeat_the_head():
    rows = ["r" * 600] * 6
    packed = X.pack_page(["table", *["table_row"] * 6], ["H", *rows], [None] * 7)
    assert len(packed) == 2 and all(t.startswith("H\n\n") and t.endswith("[/TABELA]") and len(t) <= 2500 for t, _ in packed)


def test_section_paths(spark):
    rows = [(1, 0, "heading", "Título I"), (1, 1, "heading", "Capítulo II"), (1, 2, "article", "Art. 5º Texto"), (1, 3, "text", "x"), (1, 4, "heading", "Capítulo III"), (1, 5, "text", "y"), (1, 6, "heading", "Título II"), (1, 7, "text", "z")]
    got = [r.path for r in X.section_paths(spark.createDataFrame(rows, "key int, pos bigint, kind string, text string")).orderBy("pos").collect()]
    assert got[3] == "Título I > Capítulo II > Art. 5" and got[5] == "Título I > Capítulo III" and got[7] == "Título II"


def test_rows_of_tables(spark):
    row = lambda h, c: spark.range(1).select(X.serialize_row(F.array(*map(F.lit, h)), F.array(*map(F.lit, c))).alias("x")).collect()[0].x
    assert row(["A", "B"], ["1", "2"]) == "A: 1\nB: 2" and row(["A"], ["1"]) == "1" and row(["Coluna 1", "Coluna 2"], ["1", ""]) == "1"
