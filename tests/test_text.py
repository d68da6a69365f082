import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators.identity import corpus_fingerprint, page_ranges, unique_chunk_ids


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_collapse_takes_every_blank(spark):
    assert value(spark, T.collapse(F.lit(" a \t b \n c　"))) == "a b c"
    assert value(spark, T.identity_text(lit(None))) == "" and value(spark, T.collapse(lit(None))) is None


def test_fold_and_forms(spark):
    assert value(spark, T.fold(F.lit("Segu­RANÇA  ética"))) == "seguranca etica"
    assert value(spark, T.match_form(F.lit(" – Página 3 • "))) == "página 3"
    assert len(T.MARKED) == len(T.PLAIN)


def test_signals_and_tokens(spark):
    assert value(spark, T.signals(F.lit("A LGPD nº 13.709 exige segurança e"))) == ["13.709", "exige", "lgpd", "seguranca"]
    assert value(spark, T.tokens(F.lit("A proteção de dados e o ISO 27001"))) == ["proteção", "dados", "iso", "27001"]


@pytest.mark.parametrize(("text", "language"), [("the risk of the model and its use", "en"), ("o risco de uso para uma pessoa", "pt"), ("", "pt"), (None, "pt")])
def test_language_ties_go_to_the_first(spark, text, language):
    assert value(spark, T.detect_language(lit(text))) == language


@pytest.mark.parametrize(
    ("chunk", "document"),
    [("lei_1_0123456789ab", "lei_1"), ("lei_1_0123456789ab-2", "lei_1"), ("lei_p3_c2", "lei"), ("pagina_c10", "pagina"), ("sem_forma", "sem_forma")],
)
def test_document_of(spark, chunk, document):
    assert value(spark, T.document_of(F.lit(chunk))) == document


def test_chunk_id_hashes_the_collapsed_text(spark):
    assert value(spark, T.chunk_id(F.lit("d"), F.lit(" a  b\n"))) == "d_" + hashlib.sha256(b"a b").hexdigest()[:12]


def test_embedding_text_has_no_placeholders(spark):
    make = lambda *a: value(spark, T.embedding_text(*[lit(x) for x in a]))
    assert make("T", "A", "S", "x") == "[T · A · S]\nx"
    assert make(None, " ", "S", "x") == "[S]\nx" and make(None, None, None, "x") == "x"


def test_replies(spark):
    assert value(spark, T.strip_reasoning(F.lit("<think>a\nb</think> ok"))) == "ok"
    assert value(spark, T.extract_json(F.lit('text ```json\n{"a": 1}\n``` end'))) == '{"a": 1}'
    states = {"Fim.": "ok", "Ver https://x.y/z": "ok", "a **": "stub", "parou no": "cut", "": "empty", "<think> x": "reasoning"}
    for text, state in states.items():
        assert value(spark, T.answer_state(F.lit(text))) == state


def test_lines_are_joined_over_hyphens(spark):
    assert value(spark, T.join_lines(T.page_lines(F.lit("segu-\r\nrança\n\n e  mais")))) == "segurança e mais"


def test_articulated(spark):
    assert value(spark, T.is_articulated(F.lit(" ".join(f"Art. {i} x" for i in range(1, 10)))))
    assert not value(spark, T.is_articulated(F.lit(" ".join(f"Art. {i} x" for i in range(1, 17, 2)))))


def test_fingerprint_changes_with_anything(spark):
    base = [("a", "x"), ("b", "y")]
    digest = lambda rows: corpus_fingerprint(spark.createDataFrame(rows, "id string, text string")).collect()[0].fingerprint
    seen = {digest(r) for r in (base, [("a", "x"), ("b", "z")], [("a", "x"), ("c", "y")], [("a", "xb"), ("", "y")], base[:1])}
    assert len(seen) == 5 and digest(base[::-1]) == digest(base)


def test_repeats_get_numbers(spark):
    rows = [("1", "d", "x"), ("2", "d", " x "), ("3", "d", "y"), ("4", "e", "x")]
    ids = [r.new_id for r in unique_chunk_ids(spark.createDataFrame(rows, "id string, document_id string, text string")).orderBy("id").collect()]
    assert ids[1] == ids[0] + "-2" and len(set(ids)) == 4


def test_page_ranges(spark):
    rows = [("d", p) for p in (6, 1, 2, 3, 3, None)]
    assert page_ranges(spark.createDataFrame(rows, "document_id string, page int")).collect()[0].pages == "1-3, 6"


@pytest.mark.parametrize(
    ("url", "normal"),
    [("HTTP://Ex.Org/A/?q=1#f", "http://ex.org/A?q=1"), ("https://ex.org", "https://ex.org/"), ("nada", None), (None, None)],
)
def test_normalize_url(spark, url, normal):
    assert value(spark, U.normalize_url(lit(url))) == normal


@pytest.mark.parametrize(
    ("link", "full"),
    [("/b", "http://e.org/b"), ("c.html#x", "http://e.org/a/c.html"), ("#!/p", "http://e.org/a/i#!/p"), ("mailto:x@y", None), ("//z.org/q", "http://z.org/q"), ("?k=1", "http://e.org/a/i?k=1")],
)
def test_resolve_link(spark, link, full):
    assert value(spark, U.resolve_link(F.lit("http://e.org/a/i"), F.lit(link))) == full


def test_unit_vector_of_zero(spark):
    assert value(spark, T.unit_vector(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
