import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.leakage import find_leaks, winnow
from corpusloom.llm.words import gram_hashes, word_hashes

ITEM = "O auditor externo deve conservar a cópia de segurança do exercício anterior sem prejuízo do contrato de longo prazo e da licença."


def plain(text):
    text = re.sub(r"(?<=\w)[-‐‑­][ \t]*(?:\r\n?|\n)\s*(?=\w)", "", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if unicodedata.category(c) not in ("Mn", "Cf"))
    return re.findall(r"[^\W_]+", text)


def test_words_are_compared_without_case_accents_and_line_ends():
    a, _ = word_hashes(["Cópia de SEGU-\n rança: nº 5​0"])
    b, _ = word_hashes([unicodedata.normalize("NFD", "copia, de «segurança» (no 50)")])
    assert a.tolist() == b.tolist() and len(a) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abç Ã.-\n1½ß", max_size=30), max_size=4))
def test_words_are_split_as_the_plain_definition_says(texts):
    _, offsets = word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(plain(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=12, max_size=12), st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_winnowing_misses_no_shared_span(shared, before, after):
    def kept(numbers):
        words, _ = word_hashes([" ".join(f"w{n}" for n in numbers)])
        grams = gram_hashes(words, 9)
        return set(grams[winnow(grams, 4)].tolist())

    assert kept(shared) & kept(before + shared + after)


def test_leaks_against_brute_force(spark):
    words = ITEM.split()
    docs = {
        1: "Texto antes. " + ITEM + " Texto depois.",
        2: " ".join(words[3:15]),  # 12 words
        3: " ".join(words[3:14]),  # 11 words
        4: ITEM.upper().replace(" ", "\n"),
        5: None,
        6: "",
        7: " ".join(words[:8]) + " outra coisa " + " ".join(words[8:]),
        8: ITEM + " " + "palavra " * 40_000,
    }
    corpus = spark.createDataFrame([(k, v, "s") for k, v in docs.items()] + [(1, docs[1], "s")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(90, ITEM), (91, "curto demais"), (92, None)], "item_id bigint, text string")
    got = {(r[0], r[1]) for r in find_leaks(corpus, items).collect()}

    def grams(t):
        w = plain(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    assert got == {(k, 90) for k, v in docs.items() if grams(v) & grams(ITEM)} == {(1, 90), (2, 90), (4, 90), (7, 90), (8, 90)}
    assert find_leaks(corpus.limit(0), items).count() == 0 == find_leaks(corpus, items.limit(0)).count()
    import corpusloom.llm.leakage as leakage

    limit, leakage.FILTER_LIMIT = leakage.FILTER_LIMIT, 0
    try:
        assert {(r[0], r[1]) for r in find_leaks(corpus, items).collect()} == got
    finally:
        leakage.FILTER_LIMIT = limit
