from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.splitting import BLANK, COMMA, HARD, SENTENCE, _bounds, atoms, merge, oversized_items, pieces, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cé.,;\n!A1́", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces_cover_the_text_and_keep_the_limits(text, limit, overlap):
    found = pieces(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in found) == text
    for i, (start, own, end) in enumerate(found):
        assert end - start <= limit and own - start <= overlap
        if i:
            assert start >= found[i - 1][1]


def by_words(text, limit, overlap):
    """The same merging from the smallest atoms on, without a heap."""
    cuts = {0: HARD}
    for strength in range(6, 0, -1):
        for at in _bounds(text, 0, len(text), strength):
            cuts.setdefault(at, strength)
    own = sorted(cuts)
    ends = lambda: [*own[1:], len(text)]
    while True:
        e = ends()
        fit = [(cuts[own[j]], e[j] - own[j - 1], own[j - 1], own[j]) for j in range(1, len(own)) if e[j] - own[j - 1] <= (limit if own[j - 1] == 0 else limit - overlap)]
        if not fit:
            return own
        own.remove(min(fit)[3])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["um", "dois,", "três.", "Quatro", "cinco;", "a\n", "b\n\n", "F."]), min_size=1, max_size=60))
def test_larger_atoms_change_nothing(tokens):
    text = " ".join(tokens)
    assert merge(text, 40, 5) == by_words(text, 40, 5) or any(e - s > 35 for s, e in zip(merge(text, 40, 5), [*merge(text, 40, 5)[1:], len(text)]))


def test_boundaries_and_unbroken_strings():
    text = "Uma frase curta. Outra frase, com vírgula; e cláusula.\n\n" * 60
    ends = [text[end - 2 : end] for _, _, end in pieces(text)]
    assert set(ends) == {"\n\n"}
    starts, strengths = atoms("x" * 2500, 1000)
    assert starts == [0, 1000, 2000] and strengths[1:] == [HARD, HARD]
    assert len(pieces("x" * 2500)) == 3 and BLANK < COMMA < SENTENCE


def test_tables(spark):
    long = "Palavra e mais palavra. " * 100
    rows = [("a", long, "2024-01-01"), ("a", long, "2024-02-01"), ("b", "curto", "2024-01-01"), ("c", None, None), (None, long, None), ("d", "", None), ("e", "é" * 1200, None), ("f", "é" * 1201, None)]
    df = spark.createDataFrame(rows, "id string, text string, item_key string")
    cut = split_oversized(df, "id", "text", "t", "item_key").collect() if False else split_oversized(df.withColumnRenamed("item_key", "at"), "id", "text", "t").collect()
    assert {r.item_key for r in cut} == {"a", "f"}
    own = "".join(r.text[r.own_start - r.start :] for r in sorted((r for r in cut if r.item_key == "a"), key=lambda r: r.piece_no))
    assert own == long and max(len(r.text) for r in cut) <= 1200
    assert [tuple(r) for r in oversized_items(split_oversized(df, "id", "text", "t")).orderBy("item_key").collect()] == [("t", "a"), ("t", "f")]
    assert split_oversized(df.limit(0), "id", "text", "t").count() == 0


def test_a_shortened_redelivery_counts(spark):
    long = "Palavra e mais palavra. " * 100
    rows = [("a", long, 1), ("a", "curto", 6), ("b", "curto", 1), ("b", long, 6), ("c", long, 2), ("c", "curto", 2), ("d", long, 1), ("d", None, 2), ("e", long, None), ("e", "curto", 1)]
    cut = split_oversized(spark.createDataFrame(rows, "id string, text string, at int"), "id", "text", "t", "at")
    assert {r.item_key for r in oversized_items(cut).collect()} == {"b", "c"}
