import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.tokenize import SPLIT_PATTERN, SpeculativeEncoder, TextEncoder, encode_corpus, merge_exactly, read_ranks, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary here")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    tokens = read_ranks(vocabulary_path())
    return TextEncoder(SpeculativeEncoder(tokens)), tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def ids(encoder, texts):
    flat, offsets = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="abetx AN'stç ão\n\t9日", max_size=60)), max_size=5))
def test_same_ids_as_a_plain_encoder(tools, texts):
    encoder, plain = tools
    assert ids(encoder, texts) == [plain.encode_ordinary(t) if t else [] for t in texts]


def test_special_strings_are_ordinary_text_and_long_words_work(tools):
    encoder, plain = tools
    texts = ["<|endoftext|>", "a" * 3000, "não" * 500, " " * 100]
    assert ids(encoder, texts) == [plain.encode_ordinary(t) for t in texts]


def test_very_long_words(tools):
    encoder, plain = tools
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzãé") for _ in range(120_000))
    texts = [word, "a" * 20_000, word[:5_000] + " fim", "ab " + word[:4_500]]
    began = time.perf_counter()
    assert [len(x) for x in ids(encoder, texts)] and time.perf_counter() - began < 30
    assert ids(encoder, texts[1:]) == [plain.encode_ordinary(t) for t in texts[1:]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetin stoç", min_size=1, max_size=80))
def test_merging_takes_the_lowest_rank_first(tools, text):
    ids_ = tools[0].encoder.ids
    word = text.encode()
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        ranks = [(ids_[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids_]
        if not ranks:
            break
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert merge_exactly(word, ids_) == [ids_[p] for p in parts]


def test_pairs_that_would_merge_are_found(tools):
    encoder = tools[0].encoder
    word = b"antidisestablishmentarianism"
    flat, counts, _ = encoder.encode_words([word])
    assert flat.tolist() == merge_exactly(word, encoder.ids) and counts.tolist() == [len(flat)]


def test_rows_nulls_and_extra_columns(spark, tools):
    rows = [(1, "Olá mundo", "x"), (2, None, "y"), (3, "", None), (3, "", None)]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    got = sorted((r.doc_id, list(r.ids)) for r in out)
    assert got == sorted([(1, tools[1].encode_ordinary("Olá mundo")), (2, []), (3, []), (3, [])])


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
