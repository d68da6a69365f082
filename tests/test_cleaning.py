import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cleaning as C


def pages(spark, texts, document="d"):
    rows = [(document, i, t, [x for x in t.split("\n") if x]) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id string, page int, text string, lines array<string>")


@pytest.mark.parametrize(("line", "number"), [("12", True), ("- 3 -", True), ("Página 3 de 10", True), ("xiv", True), ("civil", False), ("mild", False), ("dim", False), ("", False), ("12 dias", False)])
def test_page_numbers(spark, line, number):
    assert spark.range(1).select(C.is_page_number(F.lit(line)).alias("x")).collect()[0].x is number


def test_margins_go_and_content_stays(spark):
    body = "Uma linha de conteúdo que muda {}\noutra {}"
    p = pages(spark, [f"Diário Oficial\n{body.format(i, i * 7)}\n{i}" for i in range(1, 9)])
    assert [r.form for r in C.margin_lines(p).collect()] == ["diário oficial"]
    clean = C.clean_pages(p).orderBy("page").collect()
    assert clean[0].clean == ["Uma linha de conteúdo que muda 1", "outra 7"] and clean[0].margin_removed == 1 and clean[0].noise_removed == 1
    assert C.margin_lines(p.filter("page <= 2")).count() == 0


def test_contents_and_their_continuation(spark):
    toc = "Sumário\nCapítulo um .......... 3\nCapítulo dois .......... 9"
    more = "Capítulo três ....... 12\nCapítulo quatro ....... 15"
    prose = "Este texto corre por uma linha bem longa para que seja tomado como prosa de verdade, e termina com um ponto final."
    norm = "Art. 1º O operador deve conservar os dados.\nArt. 2º É vedado o uso."
    s = C.page_signals(pages(spark, [toc, more, prose, more, norm])).withColumn("legal", F.lit(False))
    got = [(r.state, r.reason) for r in C.classify_pages(s).orderBy("page").collect()]
    assert got == [("toc", "toc_start"), ("toc", "toc_continuation"), ("normal", None), ("normal", None), ("normal", None)]


def test_references_stop_before_an_annex(spark):
    refs = "References\n[1] Silva, A. Title. Journal, 2019.\n[2] Souza, B. Title. Report, 2020."
    more = "[3] Lima, C. Title. Journal, 2018.\n[4] Reis, D. Title. 2017, report."
    p = C.page_signals(pages(spark, ["Texto um.", "Texto dois.", "Texto três.", refs, more, "Annex A\nconteúdo"]))
    p = p.withColumn("legal", F.lit(False)).withColumn("reference_like", C.is_reference_page(F.col("lines")))
    r = C.references_span(p).collect()[0]
    assert (r.start_page, r.start_line, r.end_page) == (4, 0, 6)
    assert C.references_span(p.withColumn("legal", F.lit(True))).count() == 0


def test_every_page_has_one_status(spark):
    p = pages(spark, ["Sumário\na ...... 1\nb ...... 2", "Texto"]).union(pages(spark, ["x", "y", "z", "w", "Fim"]).filter("page = 5"))
    s = C.classify_pages(C.page_signals(p).withColumn("legal", F.lit(False)))
    counts = spark.createDataFrame([("d", 2, 3)], "document_id string, page int, chunks bigint")
    got = {r.page: r.status for r in C.page_audit(p, s, counts).collect()}
    assert got == {1: "NONINFORMATIVE_REMOVED", 2: "INDEXED", 3: "RAW_EMPTY", 4: "RAW_EMPTY", 5: "NO_CHUNKS"}


def test_rules_are_idempotent(spark):
    text = "[TABELA]\nColunas: Coluna 1 | Coluna 2\nColuna 1: valor\n[/TABELA]\n*CD252287612600*fim"
    once = spark.createDataFrame([(text,)], "t string").select(C.apply_rules(F.col("t")).alias("t"))
    a, b = once.collect()[0].t, once.select(C.apply_rules(F.col("t")).alias("t")).collect()[0].t
    assert a == b and "valor" in a and "fim" in a and "Coluna" not in a and "TABELA" not in a and "CD" not in a


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Vide o texto.\n34 CÓDIGO DE ÉTICA MÉDICA 35Art. 78. Segue", "Vide o texto. Art. 78. Segue"),
        ("fim CÓDIGO DE ÉTICA MÉDICA 7\nsegue", "fim segue"),
        ("Aprova o CÓDIGO DE ÉTICA MÉDICA.", "Aprova o CÓDIGO DE ÉTICA MÉDICA."),
        ("com base na Apresentação: centralidade", "com base na centralidade"),
        ("Apresentação: um título\nApresentação: outro", "Apresentação: um título\nApresentação: outro"),
        ("responsável da PL inteligência, em PLdiversos casos", "responsável da inteligência, em diversos casos"),
        ("segundo o PL nº 2338 e o PL 21, a PLN e a revista PLoS", "segundo o PL nº 2338 e o PL 21, a PLN e a revista PLoS"),
        ("da regra. PL CAPÍTULO III e, PL Art. 45", "da regra. CAPÍTULO III e, Art. 45"),
        ("a *CD252287612600*padrões", "a padrões"),
        ("Texto 21 September 2017 Page 3 of 30 segue", "Texto segue"),
        ("Coluna 2:\nvalor", "valor"),
    ],
)
def test_every_rule_cleans_and_spares(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(C.apply_rules(F.col("t")).alias("t")).collect()[0].t == clean


def test_rules_are_counted_by_name(spark):
    text = "na Apresentação: a PL lei 9 CÓDIGO DE ÉTICA MÉDICA x. PL ANEXO I"
    row = spark.createDataFrame([(text,)], "t string").select(*[n.alias(k) for k, n in C.rule_counts(F.col("t")).items()]).collect()[0].asDict()
    assert len(row) == 11 and {k for k, n in row.items() if n} == {"side_bar", "loose_pl", "ethics_code_footer", "pl_before_structure"}


def test_longest_chain(spark):
    numbers = [17, 18, 5630, 20, 21, 23, 30, 400]
    rows = [("k", i, n) for i, n in enumerate(numbers)]
    chain = C.longest_chain(spark.createDataFrame(rows, "key string, pos bigint, number int"))
    assert [r.number for r in chain.orderBy("pos").collect()] == [20, 21, 23, 30]
    assert C.longest_chain(spark.createDataFrame(rows[:3], "key string, pos bigint, number int")).count() == 0


def test_one_repeated_prefix_is_a_caption(spark):
    one, two = "Box 1. Title: a\n" * 3, "Level one: a\nDescription: b\n" * 3
    got = C.repeated_caption(spark.createDataFrame([("x", one), ("y", two), ("z", None)], "key string, text string")).collect()
    assert [(r.key, r.caption) for r in got] == [("x", "Box 1. Title")]


def test_short_pages(spark):
    got = [r.reason for r in C.short_page_reason(pages(spark, ["12", "ANEXO", "ANEXO", "https://x.org/a", "Um texto comum e breve."])).orderBy("page").collect()]
    assert got == ["page_number", "heading_only", "repeats_previous", "address", None]


LONG = "sem verbo nem ponto e com muitas palavras pequenas que passam de um limite"


@pytest.mark.parametrize(
    ("texts", "reason"),
    [
        (["12\nPage 3 of 9"], "page_number_only"),
        (["References\n1. A. https://a.org/1, 2001\n2. B. https://b.org/2, 2002"], "bibliographic_continuation"),
        (["• a https://a.org\n• b https://b.org", "c https://c.org " + LONG + "\nd https://d.org " + LONG], "bibliographic_continuation"),
        (["x", "c https://c.org " + LONG + "\nd https://d.org " + LONG], "cover_or_heading_only"),
        (["Primeiro capítulo ........ 3\nSegundo capítulo ........ 14\n" + LONG + "\n" + LONG + "\n" + LONG], "toc_short_or_continuation"),
        (["Photo credit: " + "\n".join([LONG] * 5)], "photo_credit_only"),
        (["World Health Organization " + LONG + "\nAvenue Appia 20 " + LONG + "\nGeneva " + LONG + "\n" + LONG + "\n" + LONG], "institutional_contact_only"),
        (["Copyright da casa " + LONG + "\nDisclaimer " + LONG + "\n" + LONG + "\n" + LONG + "\n" + LONG], "copyright_or_disclaimer"),
        (["Figure 3 " + LONG + "\n" + LONG + "\n" + LONG + "\n" + LONG + "\n" + LONG], "editorial_footer_or_figure_caption"),
        (["Keywords publication\nhttps://x.org/" + "a" * 250], "boilerplate_or_url_only"),
        (["Relatório anual\n" + LONG + "\n" + LONG + "\n" + LONG], "cover_or_heading_only"),
        (["Relatório anual\n" + LONG + "\n" + LONG + "\n" + LONG + "\n" + LONG], None),
        (["O prazo de guarda do prontuário é de vinte anos."], None),
        (["Art. 1 a regra\nArt. 2 outra"], None),
        ([""], None),
    ],
)
def test_pages_that_carry_nothing(spark, texts, reason):
    assert C.noninformative_short_page(pages(spark, texts)).orderBy(F.desc("page")).collect()[0].reason == reason


def test_validation_and_reconciliation(spark):
    schema = "id string, text string, metadata struct<document_id:string,source:string,source_type:string,title:string,page:int,chunk:int>"
    c = spark.createDataFrame([("a", "x", ("d", "s", "PDF", "t", 1, 1)), ("b", " ", ("e", "s", "pdf ", "", None, 1))], schema)
    assert {(r.id, r.problem) for r in C.violations(c).collect()} == {("b", "empty_text"), ("b", "no_title"), ("b", "pdf_without_page")}
    m = spark.createDataFrame([("d.pdf",), ("d",), ("f.pdf",)], "filename string")
    assert {tuple(r) for r in C.reconcile(m, c).collect()} == {("d", "registered_twice"), ("f", "without_chunks"), ("e", "not_registered")}


def test_references_are_cut(spark):
    pages = spark.createDataFrame([("d", 1, ["a"]), ("d", 2, ["b", "Referências", "x"]), ("d", 3, ["y"]), ("d", 4, ["Anexo"]), ("e", 1, ["z", "References", "r"]), ("e", 2, ["s"]), ("f", 1, ["k"])], "document_id string, page int, lines array<string>")
    spans = spark.createDataFrame([("d", 2, 1, 4), ("e", 1, 1, None)], "document_id string, start_page int, start_line int, end_page int")
    got = {(r.document_id, r.page): r.lines for r in C.cut_references(pages, spans).collect()}
    assert got == {("d", 1): ["a"], ("d", 2): ["b"], ("d", 3): [], ("d", 4): ["Anexo"], ("e", 1): ["z"], ("e", 2): []}
