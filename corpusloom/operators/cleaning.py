"""Cleaning and classification of document pages: lines, margins, tables of contents, references, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, match_form

# Patterns of lines, written without look-around so that any engine reads them alike.
EDGE = r"(?:^|[^\p{L}\p{N}_])"
PAGE_NUMBER = r"(?i)^(?:[0-9]+|[-–—] *[0-9]+ *[-–—]|[0-9]+ */ *[0-9]+|(?:page|página|pagina) +[0-9]+(?: +(?:of|de) +[0-9]+)?|[0-9]+ +(?:of|de) +[0-9]+)$"
ROMAN = r"(?i)^m*(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$"
ONLY_RULES = r"^[-–—_=*•·. ]+$"
CONTENTS_LINE = r"\.{3,} *[0-9]+$|  +[0-9]+$"
LEGAL_TERMS = ["legislação", "lei", "resolução", "regulation", "regulamento", "rdc", "projeto de lei"]
TOC_HEADS = r"^(?:contents$|sumário|table of contents)"
SUBJECT_INDEX_HEADS = r"^(?:índice remissivo|indice remissivo|subject index|alphabetical index)"
INDEX_HEADS = r"^(?:índice|indice)"
LIST_HEADS = r"^(?:lista de figuras|lista de tabelas|list of figures|list of tables)"
THANKS_HEADS = r"^(?:agradecimentos|acknowledgements|acknowledgments)"
LOCATOR = EDGE + r"(?:(?i:cap(?:[íi]tulo)?\.?|art(?:igo)?s?\.?|§|par[aá]grafo|inciso|p(?:p)?\.)) *(?:(?i:[ivxlcdm]+)|[0-9]+)"
PROVISION = r"(?i)^(?:(?:art\.?|artigo|par[aá]grafo|inciso)(?:$|[^\p{L}\p{N}_])|§ *[0-9]+)"
PRESCRIBES = r"(?i)" + EDGE + r"(?:deve|dever[aá]|[ée] vedado|fica vedado|proibido|obrigat[oó]rio)(?:$|[^\p{L}\p{N}_])"
REFERENCE_HEADS = ["references", "bibliography", "referências", "referencias", "referências bibliográficas", "referencias bibliograficas", "bibliografia", "works cited"]
SUBSTANTIVE_HEADS = r"(?i)^(?:annex|appendix|glossary|definitions?|recommendations?)(?:$|[^\p{L}\p{N}_])"
ENTRY = r"^(?:\[[0-9]{1,4}\]|[0-9]{1,4}[.)]) +|\[[0-9]{1,4}\] *[.,;)]?$"
ADDRESS = r"(?i)https?://|doi *: *|doi\.org/"
PUBLISHED = r"(?i)" + EDGE + r"(?:et +al\.?|vol\.?|pp?\.? *[0-9]|retrieved|accessed|proceedings|publisher|journal|report)(?:$|[^\p{L}\p{N}_])"
YEAR = EDGE + r"(?:19|20)[0-9]{2}(?:$|[^\p{L}\p{N}_])"
#: The rules that any engine reads alike: those the SQL states.
RULES = [
    ("invented_header", r"Colunas:[ \t\n]*(?:Coluna[ \t]*[0-9]+[ \t]*\|?[ \t\n]*)+", ""),
    ("invented_label", r"(?m)^[ \t]*Coluna[ \t]*[0-9]+:[ \t]*", ""),
    ("table_mark", r"\[/?TABELA\]\n?", ""),
    ("loose_column", r"\|[ \t]*Coluna[ \t]*[0-9]+", ""),
    ("watermark", r"\*CD[0-9]{10,}\*", ""),
    ("page_footer", r"[ \t\n]*[0-9]{1,2} +\w+ +[0-9]{4} +Page +[0-9]+ +of +[0-9]+", ""),
]
#: All rules of leftover table scaffolding, watermarks, side bars and footers, in the order they are applied; each match becomes one blank.
ALL_RULES = [
    ("invented_header", r"(?U)Colunas:\s*(?:Coluna\s*\d+\s*\|?\s*)+\n?"),
    ("invented_label", r"(?Udm)^[ \t]*Coluna\s*\d+:[ \t]*$\n?"),
    ("invented_label_inline", r"(?Udm)^[ \t]*Coluna\s*\d+:[ \t]*"),
    ("table_mark", r"\[/?TABELA\]\n?"),
    ("ethics_code_footer", r"(?U)\s*\d{1,3}\s*CÓDIGO\s*(?:DE\s*)?ÉTICA\s*MÉDICA\s*(?:DE)?\s*\d{0,3}\s*|\s*CÓDIGO\s*(?:DE\s*)?ÉTICA\s*MÉDICA\s*(?:DE)?\s*\d{1,3}\s*"),
    ("loose_column", r"(?U)\|\s*Coluna\s*\d+\b"),
    ("watermark", r"(?U)\*CD\d{10,}\*"),
    ("side_bar", r"(?dm)(?<!^)Apresenta[çc][ãa]o:"),
    ("loose_pl", r"(?U)(?<=[a-zà-ÿ,]\s)PL(?![\s.]*(?:n[ºo°]?\.?\s*)?\d)(?=\s+[a-zà-ÿ]|[A-ZÀ-Ýa-zà-ÿ][a-zà-ÿ])"),
    ("pl_before_structure", r"(?U)(?<=[a-zà-ÿ,.]\s)PL\s+(?=(?:CAPÍTULO|TÍTULO|SEÇÃO|Seção|Subseção|Artigo|Parágrafo|ANEXO)\b|Art\.)"),
    ("page_footer", r"(?U)\s*\d{1,2}\s+\w+\s+\d{4}\s+Page\s+\d+\s+of\s+\d+"),
]
EDITORIAL = r"Supervis[ãa]o editorial|Copidesque|Diagrama[çc][ãa]o|Projeto [Gg]r[áa]fico|ISBN|Dados Internacionais de Cataloga|COMPOSI[ÇC][ÃA]O DO CONSELHO|Conselheiros? (?:titulares|suplentes)|COMISS[ÃA]O NACIONAL DE REVIS[ÃA]O|COMISS[ÕO]ES ESTADUAIS"
VERBS = ["deverá", "deverão", "deve", "devem", "será", "serão", "é", "são", "fica", "ficam", "cabe", "cabendo", "compete", "poderá", "exercer", "aplicar", "entrar"]
DEONTIC = r"(?i)" + EDGE + r"(?:deve|deverá|devem|shall|must|vedado|debe|deberá)(?:$|[^\p{L}\p{N}_])"


def pages_of(chunks: DataFrame) -> DataFrame:
    """Columns (document_id, page, text, lines) from chunks with id, text and metadata; chunks of a page in order."""
    rows = chunks.filter("metadata.page IS NOT NULL AND text IS NOT NULL").select(F.col("metadata.document_id").alias("document_id"), F.col("metadata.page").cast("int").alias("page"), F.struct(F.col("metadata.chunk").alias("k"), "id", "text").alias("c"))
    text = rows.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]), "\n").alias("text"))
    return text.withColumn("lines", F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), collapse), lambda x: x != ""))


def is_page_number(line: Column) -> Column:
    bare = F.btrim(line, F.lit("-–— "))
    return line.rlike(PAGE_NUMBER) | ((bare != "") & bare.rlike(ROMAN))


def is_noise(line: Column) -> Column:
    return (line == "") | is_page_number(line) | ((F.length(line) <= 2) & ~line.rlike(r"^\p{L}+$")) | line.rlike(ONLY_RULES)


def margin_lines(pages: DataFrame, edge: int = 4, share: float = 0.25, least: int = 3) -> DataFrame:
    """Columns (document_id, form): lines that repeat in the first or last lines of a document's pages."""
    n = F.size("lines")
    placed = pages.select("document_id", "page", n.alias("n"), F.posexplode("lines").alias("at", "line")).filter((F.col("at") < edge) | (F.col("at") >= F.col("n") - edge))
    forms = placed.select("document_id", "page", match_form(F.col("line")).alias("form")).filter(F.length("form").between(4, 180)).distinct()
    counts = forms.groupBy("document_id", "form").agg(F.count("*").alias("pages"))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("total")).filter(F.col("total") >= 3)
    return counts.join(sizes, "document_id").filter(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("total") * share))).select("document_id", "form", "pages")


def clean_pages(pages: DataFrame, edge: int = 4) -> DataFrame:
    """Columns (document_id, page, clean, margin_removed, noise_removed): pages without repeated margins and noise."""
    margins = margin_lines(pages, edge).groupBy("document_id").agg(F.collect_set("form").alias("forms"))
    joined = pages.join(margins, "document_id", "left").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))
    n = F.size("lines")
    marked = F.transform("lines", lambda x, i: F.struct(x.alias("line"), (((i < edge) | (i >= n - edge)) & F.array_contains("forms", match_form(x))).alias("margin"), is_noise(x).alias("noise")))
    kept = joined.withColumn("m", marked)
    return kept.select(
        "document_id",
        "page",
        F.transform(F.filter("m", lambda x: ~x["margin"] & ~x["noise"]), lambda x: x["line"]).alias("clean"),
        F.size(F.filter("m", lambda x: x["margin"])).alias("margin_removed"),
        F.size(F.filter("m", lambda x: ~x["margin"] & x["noise"])).alias("noise_removed"),
    )


def is_legal(document_type: Column, title: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(document_type, F.lit("")), F.lit("\n"), F.coalesce(title, F.lit(""))))
    return both.rlike("|".join(LEGAL_TERMS))


def _some(c: Column, pattern: str) -> Column:
    return F.exists(c, lambda x: x.rlike(pattern))


def _many(c: Column, pattern: str) -> Column:
    return F.size(F.filter(c, lambda x: x.rlike(pattern)))


def page_signals(pages: DataFrame) -> DataFrame:
    """The pages with the local features their classification uses."""
    heads = F.transform(F.slice("lines", 1, 8), lambda x: F.regexp_replace(match_form(x), r"^[0-9]+ +([a-zà-ÿ])", "$1"))
    p = pages.withColumn("heads", heads)
    lines = F.col("lines")
    n = F.size(lines)
    return p.select(
        "document_id",
        "page",
        "lines",
        n.alias("n"),
        F.length(F.array_join(lines, " ")).alias("chars"),
        _some(F.col("heads"), TOC_HEADS).alias("toc_head"),
        _some(F.col("heads"), SUBJECT_INDEX_HEADS).alias("subject_head"),
        _some(F.col("heads"), INDEX_HEADS).alias("index_head"),
        _some(F.col("heads"), LIST_HEADS).alias("list_head"),
        _some(F.col("heads"), THANKS_HEADS).alias("thanks_head"),
        _some(F.col("heads"), SUBSTANTIVE_HEADS).alias("substantive_head"),
        _many(lines, CONTENTS_LINE).alias("toc_lines"),
        F.when(n > 0, F.size(F.filter(lines, lambda x: F.length(x) <= 110)) / n).otherwise(0.0).alias("short_share"),
        _many(lines, LOCATOR).alias("locators"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ].{2,90}") & x.rlike(LOCATOR))).alias("entries"),
        ((F.size(F.filter(lines, lambda x: x.rlike(PROVISION) & x.rlike(PRESCRIBES))) > 0) | (_many(lines, PROVISION) >= 2)).alias("normative"),
        (_many(lines, r"^[^:]{2,70}: +.{25,}$") >= 2).alias("glossary"),
        F.size(F.filter(lines, lambda x: (F.length(x) >= 100) & x.rlike(r"[.!?]$"))).alias("prose"),
    )


def classify_pages(signals: DataFrame) -> DataFrame:
    """Columns (document_id, page, state, reason): contents, subject index and their continuations.

    A page either sets the state whatever came before or may go on with the state of the page before; so
    a run begins at a setting page and lasts while every page since allows its state: two window functions,
    no loop.  reason is null where the page is kept.
    """
    locators = (F.col("locators") >= 4) & (F.col("locators") / F.col("n") >= 0.45) & (F.col("entries") >= 2) & (F.col("short_share") >= 0.65) & (F.col("prose") == 0) & ~F.col("glossary") & ~F.col("normative") & (F.col("n") > 0)
    index = locators & (F.col("subject_head") | F.col("index_head"))
    toc = ~F.col("normative") & ~index & (F.col("toc_lines") >= 2) & (F.col("toc_head") | (F.col("index_head") & ~F.col("subject_head")))
    goes_toc = (F.col("toc_lines") >= 2) & (F.col("prose") == 0)
    sets = F.when(F.col("normative"), "normal").when(index, "subject_index").when(toc, "toc").when(~goes_toc & ~locators, "normal")
    s = signals.withColumns({"sets": sets, "goes_toc": goes_toc, "goes_index": locators})
    order = Window.partitionBy("document_id").orderBy("page")
    s = s.withColumn("run", F.count("sets").over(order))
    run = Window.partitionBy("document_id", "run").orderBy("page")
    first = F.first("sets").over(run)
    inside = F.col("sets").isNull()
    s = s.withColumns({"first": first, "inside": inside, "toc_on": F.min(F.when(inside, F.col("goes_toc")).otherwise(True)).over(run), "index_on": F.min(F.when(inside, F.col("goes_index")).otherwise(True)).over(run)})
    state = F.when(~F.col("inside"), F.col("sets")).when((F.col("first") == "toc") & F.col("toc_on"), "toc").when((F.col("first") == "subject_index") & F.col("index_on"), "subject_index").otherwise("normal")
    static = (
        F.when(F.col("n") == 0, "empty")
        .when((F.col("toc_head") | F.col("index_head")) & ((F.col("toc_lines") >= 2) | (F.col("chars") < 2500)), "toc_start")
        .when(F.col("list_head"), "list")
        .when(~F.col("legal") & F.col("thanks_head") & (F.col("chars") < 3500), "acknowledgements")
    )
    kind = F.when(F.col("normative"), F.lit(None)).when(F.col("state") != "normal", F.concat("state", F.when(F.col("inside"), "_continuation").otherwise("_start"))).otherwise(static)
    return s.withColumn("state", state).select("document_id", "page", "state", kind.alias("reason"))


def references_span(pages: DataFrame) -> DataFrame:
    """Columns (document_id, start_page, start_line, end_page): the bibliography of documents that are not legal.

    It starts at the first heading of its kind after 55 % of the pages and ends before the first later page
    that opens a section or has too little evidence of being a bibliography; end_page is null if none does.
    """
    w = Window.partitionBy("document_id").orderBy("page")
    total = F.count("*").over(Window.partitionBy("document_id"))
    at = pages.filter("NOT legal").withColumns({"nth": F.row_number().over(w) - 1, "total": total})
    late = at.filter(F.col("nth") >= F.floor(F.col("total") * 0.55)).select("document_id", "page", F.posexplode("lines").alias("line_no", "line"))
    form = match_form(F.col("line"))
    heads = late.filter(form.isin(REFERENCE_HEADS) | ((F.length(form) <= 35) & F.startswith(form, F.lit("references"))))
    start = heads.groupBy("document_id").agg(F.min(F.struct("page", "line_no")).alias("s")).select("document_id", F.col("s.page").alias("start_page"), F.col("s.line_no").alias("start_line"))
    after = pages.join(start, "document_id").filter(F.col("page") > F.col("start_page"))
    stop = after.filter(F.col("substantive_head") | F.col("normative") | ~F.col("reference_like")).groupBy("document_id").agg(F.min("page").alias("end_page"))
    return start.join(stop, "document_id", "left")


def cut_references(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages (document_id, page, lines) of the documents in spans without the lines from the start of the bibliography to the page it has ended on."""
    j = pages.join(spans, "document_id")
    first = F.slice("lines", F.lit(1), F.col("start_line").cast("int"))
    within = (F.col("page") > F.col("start_page")) & (F.col("end_page").isNull() | (F.col("page") < F.col("end_page")))
    return j.select("document_id", "page", F.when(F.col("page") == F.col("start_page"), first).when(within, F.array().cast("array<string>")).otherwise(F.col("lines")).alias("lines"))


def is_reference_page(lines: Column) -> Column:
    real = F.filter(lines, lambda x: ~is_page_number(x))
    numbered, address, published = _many(real, ENTRY), _many(real, ADDRESS), _many(real, PUBLISHED)
    years = F.size(F.filter(real, lambda x: x.rlike(YEAR) & x.rlike(r"[,.(]")))
    return ((numbered >= 2) & (address == 0) & (years == 0)) | ((numbered >= 2) & ((address >= 1) | (years >= 2))) | ((address >= 3) & (years >= 2)) | ((published >= 3) & (years >= 2))


def short_page_reason(pages: DataFrame, most: int = 180) -> DataFrame:
    """Columns (document_id, page, reason): why a short page carries nothing; the page before is joined by its number.

    Rules in order: empty, only numbers, only rules, repeats the page before, an address alone, a heading alone.
    """
    before = pages.select("document_id", (F.col("page") + 1).alias("page"), F.array_join("lines", "\n").alias("previous"))
    text = F.array_join("lines", "\n")
    p = pages.join(before, ["document_id", "page"], "left").withColumn("body", text)
    reason = (
        F.when(F.col("body") == "", "empty")
        .when(F.length("body") > most, F.lit(None))
        .when(F.forall("lines", is_page_number), "page_number")
        .when(F.forall("lines", is_noise), "noise")
        .when(F.col("body") == F.col("previous"), "repeats_previous")
        .when((F.size("lines") == 1) & F.col("body").rlike(r"^(?:https?://|www\.)[^ ]+$"), "address")
        .when((F.size("lines") == 1) & (F.length("body") <= 60) & F.col("body").rlike(r"^[\p{Lu}\p{N} .,–-]+$"), "heading_only")
    )
    return p.select("document_id", "page", reason.alias("reason"))


def _words(pattern: str) -> str:
    return r"(?iU)\b(?:" + pattern + r")\b"


def joined_lines(lines: Column) -> Column:
    """The lines as one line; a word cut by a hyphen is joined."""
    text = F.array_join(F.transform(lines, lambda x: F.when(x.endswith("-"), F.concat(x.substr(F.lit(1), F.length(x) - 1), F.lit("\x01"))).otherwise(x)), " ")
    text = F.regexp_replace(F.regexp_replace(text, "\x01 ", ""), "\x01$", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\s+(\w)", "$1$2"), r"(?U)\s+", " "))


def noninformative_short_page(pages: DataFrame) -> DataFrame:
    """Columns (document_id, page, reason): why a page carries nothing, null if it is kept; the page before is joined by its number.

    Nine rules in order, each with its own condition of length or none: only page numbers, a bibliography
    that goes on, a table of contents, a photo credit, an address of an institution, a copyright notice, an
    editorial footer or caption, an address alone (up to 350 characters), a cover or heading (up to 300).
    """
    real = F.filter("lines", lambda x: ~is_page_number(x))
    s = page_signals(pages).withColumns({"real": real, "like": is_reference_page(F.col("lines"))})
    s = s.withColumns({"r": F.size("real"), "first": F.coalesce(F.get("real", F.lit(0)), F.lit("")), "body": joined_lines(F.col("lines")), "sources": _many(F.col("real"), ADDRESS)})
    heads = r"(?iU)^(?:references?|bibliograph(?:y|ies)|how[- ]to articles?)\b"
    s = s.withColumns({"bullet": F.col("first").rlike(r"^[•*-]"), "source_head": match_form(F.col("first")).rlike(heads), "length": F.length("body")})
    shape = (F.col("r") > 0) & (F.col("sources") >= 2) & (F.col("prose") == 0) & (F.col("short_share") >= 0.9) & ~F.col("substantive_head") & (F.col("bullet") | F.col("source_head"))
    before = s.select("document_id", (F.col("page") + 1).alias("page"), shape.alias("goes_on"))
    p = s.join(before, ["document_id", "page"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))

    sentence = F.exists("real", lambda x: (F.length(x) >= 30) & (F.regexp_count(x, F.lit(r"[A-Za-zÀ-ÿ]{3,}")) >= 5) & x.rlike(r"[.!?]$"))
    structure = F.col("normative") | F.col("glossary") | F.col("substantive_head") | sentence | ((F.col("r") >= 4) & (_many(F.col("real"), r"(?U)\b[A-Z][A-Z0-9/-]{1,12}\b") >= 3))
    p = p.withColumns({"sentence": sentence, "structure": structure, "prosy": F.col("prose") > 0})
    body, lines, free = F.col("body"), F.col("real"), ~F.col("normative")
    bare = ~F.col("prosy") & ~F.col("sentence") & ~F.col("structure")
    bibliography = (F.col("sources") >= 2) & (F.col("like") | F.col("goes_on")) & ((F.col("bullet") & (_many(lines, r"^[•*-]") >= 2)) | F.col("source_head") | F.col("goes_on")) & ~F.col("substantive_head") & free & ~body.rlike(_words("glossary|definitions?|acronyms?|symbols?"))
    toc = (F.col("toc_lines") >= 2) & (F.col("toc_head") | (F.col("index_head") & ~F.col("subject_head")) | ~F.col("prosy"))
    contact = _many(lines, r"(?iU)\b(?:world health organization|organization|department|division|avenue|street|road|geneva|switzerland|secretariat|website|www\.)\b") >= 3
    rights = _many(lines, _words(r"copyright|disclaimer|terms\s+and\s+conditions|visit\s+our\s+website|all\s+other\s+rights\s+are\s+reserved")) >= 2
    footer = body.rlike(r"(?iU)\A(?:additional\s+resources?\s*:\s*see\s+.+|(?:figure|fig\.?|photo)\s+.+)\z") | ((F.col("r") <= 3) & F.forall(lines, lambda x: F.lower(x).contains("additional resources")))
    left = F.regexp_replace(F.regexp_replace(body, r"(?iU)https?://\S+|www\.\S+|doi\.org/\S+", ""), _words(r"available\s+free\s+of\s+charge|publication|keywords?"), "")
    words = F.size(F.filter(F.split(F.regexp_replace(left, r"(?U)[\d\W_]+", " "), " "), lambda x: x != ""))
    reason = (
        F.when(F.col("n") == 0, F.lit(None))
        .when(F.col("r") == 0, "page_number_only")
        .when(bibliography, "bibliographic_continuation")
        .when(toc, "toc_short_or_continuation")
        .when(body.rlike(r"(?iU)\bphoto\s+credit\b|\bcr[ée]dito\s+da\s+foto\b") & bare, "photo_credit_only")
        .when(contact & free & ~F.col("structure"), "institutional_contact_only")
        .when(rights & free, "copyright_or_disclaimer")
        .when(footer & ~F.col("structure"), "editorial_footer_or_figure_caption")
        .when((F.col("length") <= 350) & (words <= 8) & bare, "boilerplate_or_url_only")
        .when((F.col("length") <= 300) & bare & (F.col("r") <= 6), "cover_or_heading_only")
    )
    return p.select("document_id", "page", reason.alias("reason"))


def page_audit(pages: DataFrame, classified: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """One row a page with exactly one status, and the pages missing between 1 and the last one as RAW_EMPTY."""
    last = pages.groupBy("document_id").agg(F.max("page").alias("last"))
    every = last.select("document_id", F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("page"))
    known = pages.select("document_id", "page", F.length("text").alias("raw_chars"), F.size("lines").alias("n")).join(classified, ["document_id", "page"], "left").join(chunk_counts, ["document_id", "page"], "left")
    all_ = every.join(known, ["document_id", "page"], "full")
    status = F.when(F.col("raw_chars").isNull(), "RAW_EMPTY").when(F.col("n") == 0, "EMPTY_AFTER_CLEANING").when(F.col("reason").isNotNull(), "NONINFORMATIVE_REMOVED").when(F.coalesce("chunks", F.lit(0)) == 0, "NO_CHUNKS").otherwise("INDEXED")
    return all_.select("document_id", "page", status.alias("status"), F.coalesce("raw_chars", F.lit(0)).alias("raw_chars"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def apply_rules(c: Column) -> Column:
    """A text after all rules; blanks are joined where they left holes."""
    for _, pattern in ALL_RULES:
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rule_counts(c: Column) -> dict[str, Column]:
    """How often each rule applies, in order, each on what the rules before it left."""
    counts: dict[str, Column] = {}
    for name, pattern in ALL_RULES:
        counts[name] = F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, " ")
    return counts


def loose_numbers(c: Column) -> Column:
    """Whole numbers of up to five digits that stand alone between blanks."""
    return F.transform(F.filter(F.split(c, r"[ \t\r\n]+"), lambda x: x.rlike(r"^[0-9]{1,5}$")), lambda x: x.cast("int"))


def has_line_numbers(c: Column) -> Column:
    """Whether a text numbers its lines: dense loose numbers that mostly rise."""
    n = loose_numbers(c)
    rises = F.size(F.filter(F.zip_with(F.slice(n, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: b > a), lambda x: x))
    return (F.size(n) >= 50) & (F.length(c) / F.greatest(F.size(n), F.lit(1)) < 150) & (rises / F.greatest(F.size(n) - 1, F.lit(1)) > 0.75)


def longest_chain(tokens: DataFrame, least: int = 4, step: int = 15) -> DataFrame:
    """Of (key, pos, number): the positions of each key's longest run of numbers that rise by 1 to `step`, the first of equal length."""
    w = Window.partitionBy("key").orderBy("pos")
    d = F.col("number") - F.lag("number").over(w)
    runs = tokens.withColumn("breaks", F.when(d.between(1, step), 0).otherwise(1)).withColumn("run", F.sum("breaks").over(w))
    sizes = runs.groupBy("key", "run").agg(F.count("*").alias("size"), F.min("pos").alias("first")).filter(F.col("size") >= least)
    best = sizes.groupBy("key").agg(F.min(F.struct(-F.col("size"), "first", "run")).alias("b")).select("key", F.col("b.run").alias("run"))
    return runs.join(best, ["key", "run"]).select("key", "pos", "number")


def repeated_caption(rows: DataFrame) -> DataFrame:
    """Of (key, text): the prefix before a colon that opens three lines or more, where exactly one such prefix repeats."""
    lines = rows.select("key", F.explode(F.split("text", "\n")).alias("line"))
    prefix = F.trim(F.regexp_extract("line", r"^[ \t]*([^\n:]{6,120}):[ \t]", 1))
    counts = lines.select("key", prefix.alias("prefix")).filter("prefix <> ''").groupBy("key", "prefix").agg(F.count("*").alias("n")).filter("n >= 3")
    return counts.groupBy("key").agg(F.count("*").alias("k"), F.min("prefix").alias("caption")).filter("k = 1").select("key", "caption")


def is_editorial(c: Column) -> Column:
    """Front or back matter: an editorial mark in a text of mostly capitalised words and hardly a verb."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ÿ]{2,}"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-ZÀ-ÖØ-Þ]"))) / n
    verbs = F.size(F.filter(words, lambda w: F.lower(w).isin(VERBS))) / n
    return c.rlike(EDITORIAL) & (F.size(words) >= 10) & (capitals > 0.45) & (verbs < 0.04)


def integrity(chunks: DataFrame) -> DataFrame:
    """One row a document: chunks, prescriptive chunks, clauses, page gaps, and what to do first, most urgent first."""
    c = chunks.select(F.col("metadata.document_id").alias("document_id"), F.col("metadata.page").alias("page"), "text")
    per = c.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"),
        F.count_if(F.col("text").rlike(DEONTIC)).alias("prescriptive"),
        F.sum(F.coalesce(F.regexp_count("text", F.lit(r"(?:Art\.|Artigo|Article|Artículo) *[0-9]+")), F.lit(0))).cast("long").alias("clauses"),
        F.count_distinct("page").alias("pages"),
        F.max("page").cast("long").alias("last_page"),
        F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"),
    )
    gap = F.coalesce(F.col("last_page"), F.lit(0)) - F.col("pages")
    advice = F.when(F.col("empty") > 0.05 * F.col("chunks"), "extract_again").when(gap > 0, "missing_pages").when((F.col("prescriptive") == 0) & (F.col("clauses") == 0), "review").otherwise("keep")
    return per.withColumn("gap", gap).withColumn("advice", advice)


def reconcile(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents of either side that the other lacks, and registrations that repeat: (document_id, finding)."""
    m = manifest.select(F.regexp_replace(F.trim("filename"), r"\.pdf$", "").alias("document_id"))
    c = chunks.select(F.col("metadata.document_id").alias("document_id")).filter("document_id IS NOT NULL").distinct()
    twice = m.groupBy("document_id").count().filter("count > 1").select("document_id", F.lit("registered_twice").alias("finding"))
    missing = m.distinct().join(c, "document_id", "left_anti").select("document_id", F.lit("without_chunks").alias("finding"))
    unknown = c.join(m, "document_id", "left_anti").select("document_id", F.lit("not_registered").alias("finding"))
    return twice.union(missing).union(unknown)


def violations(chunks: DataFrame) -> DataFrame:
    """One row (id, problem) for each rule a chunk record breaks."""
    m = F.col("metadata")
    rules = {"no_id": F.col("id").isNull() | (F.trim("id") == ""), "empty_text": F.col("text").isNull() | (F.trim("text") == ""), "no_document": m["document_id"].isNull(), "no_title": m["title"].isNull() | (F.trim(m["title"]) == ""), "no_source": m["source"].isNull(), "pdf_without_page": (F.upper(F.trim(m["source_type"])) == "PDF") & m["page"].isNull(), "no_chunk_number": m["chunk"].isNull()}
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return chunks.select("id", F.explode(found).alias("problem"))
