"""Scalar text functions as column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: What counts as white space, as a character class both engines read alike.
BLANK_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters with marks and their plain forms.
MARKED = "áàâãäåāăąçćčďđéèêëēėęěíìîïīįñńňóòôõöøōőśšťúùûüūůűýÿžźżÁÀÂÃÄÅĀĂĄÇĆČĎĐÉÈÊËĒĖĘĚÍÌÎÏĪĮÑŃŇÓÒÔÕÖØŌŐŚŠŤÚÙÛÜŪŮŰÝŸŽŹŻ"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiinnnoooooooosstuuuuuuuyyzzzAAAAAAAAACCCDDEEEEEEEEIIIIIINNNOOOOOOOOSSTUUUUUUUYYZZZ"
STOP_PT = "a ao aos as com como da das de do dos e em entre na nas no nos o os ou para pela pelas pelo pelos por que se sem sob sua suas seu seus um uma não mais".split()
STOP_EN = "a an and are as at be by for from has have in is it its of on or not that the this to was were which with".split()
#: Markers of a language, with a blank on either side.
MARKERS = {"pt": ["de", "que", "não", "para", "uma", "os", "em", "como"], "en": ["the", "of", "and", "to", "in", "is", "for", "that"]}


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, f"{BLANK_CLASS}+", " "))


def identity_text(c: Column) -> Column:
    """As collapse, with null as the empty string: what content ids are made from."""
    return F.coalesce(collapse(c), F.lit(""))


def match_form(c: Column) -> Column:
    """A line for comparison: lower case, without rules, bullets and closing punctuation at its ends."""
    return F.btrim(F.lower(collapse(c)), F.lit(' -–—•·.:;|"'))


def unaccent(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), MARKED, PLAIN)


def fold(c: Column) -> Column:
    """Without soft hyphens, case, accents and doubled blanks."""
    return collapse(unaccent(F.lower(F.regexp_replace(c, "­", ""))))


def signals(c: Column) -> Column:
    """Sorted set of words of five letters and more, numbers and acronyms of a text, without accents."""
    plain = unaccent(c)
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z]{5,}"), F.lit(0))
    numbers = F.regexp_extract_all(plain, F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    acronyms = F.transform(F.regexp_extract_all(plain, F.lit(r"[A-Z]{3,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.concat(words, numbers, acronyms)))


def tokens(c: Column, stop: list[str] | None = None, least: int = 2) -> Column:
    """Words for lexical search in reading order: lower case, at least `least` characters, no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Zà-úÀ-Ú0-9]+"), F.lit(0))
    words = sorted(set(STOP_PT + STOP_EN) if stop is None else stop)
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(words))


def light_stem(c: Column) -> Column:
    """Cuts plural and the commonest endings of Portuguese and English words of six letters and more."""
    cut = F.regexp_replace(c, "(ções|coes)$", "cao")
    cut = F.regexp_replace(cut, "(mente|idades|idade|amentos|amento|imentos|imento|ings|ing|ed|es|s)$", "")
    return F.when(F.length(c) >= 6, cut).otherwise(c)


def _count(c: Column, marker: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)


def detect_language(c: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """The language whose markers stand most often in the text; the first language wins ties."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    langs = list((markers or MARKERS).items())
    sums = [sum((_count(padded, f" {m} ") for m in ms), F.lit(0.0)) for _, ms in langs]
    best, out = sums[0], F.lit(langs[0][0])
    for (name, _), s in zip(langs[1:], sums[1:]):
        out = F.when(s > best, F.lit(name)).otherwise(out)
        best = F.greatest(best, s)
    return out


def article_numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:Art\.|Article|Artigo)[ ]*([0-9]{1,4})"), F.lit(1)), lambda n: n.cast("int")))


def is_articulated(c: Column, least: int = 8) -> Column:
    """Whether at least `least` article numbers are followed by their successor."""
    return F.size(F.filter(article_numbers(c), lambda n: F.array_contains(article_numbers(c), n + 1))) >= least


def issuer(author: Column) -> Column:
    return F.left(F.trim(F.split_part(author, F.lit(";"), F.lit(1))), F.lit(40))


def semicolon_list(c: Column) -> Column:
    """Trimmed non-empty entries of a list written with semicolons; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def page_lines(c: Column) -> Column:
    """Lines of a page, collapsed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), collapse), lambda x: x != "")


def join_lines(lines: Column) -> Column:
    """One text from lines; a hyphen that ends a line is closed up when a letter follows."""
    return collapse(F.regexp_replace(F.array_join(lines, "\n"), r"([\p{L}0-9_])-\s+([\p{L}0-9_])", "$1$2"))


def strip_reasoning(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def extract_json(c: Column) -> Column:
    """The JSON object or array in a reply: fences dropped, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")))
    return F.when(F.get_json_object(bare, "$").isNotNull(), bare).when(F.get_json_object(inner, "$").isNotNull(), inner)


def answer_state(c: Column) -> Column:
    """Whether a reply looks whole: ok, reasoning left open, stub or cut."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == ""), "empty")
        .when(t.contains("<think>"), "reasoning")
        .when(t.rlike(r"(\*\*|[-*#|:])$"), "stub")
        .when(t.rlike(r"[.!?)]$") | t.rlike(r"https?://[^ ]+$") | t.rlike(r'["}\]]$'), "ok")
        .otherwise("cut")
    )


def embedding_text(title: Column, author: Column, section: Column, text: Column) -> Column:
    """Text to embed: a bracket with the parts of the context there are, a line break, the text."""
    parts = [F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in (title, author, section)]
    head = F.concat_ws(" · ", *parts)
    return F.when(head == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce(text, F.lit(""))))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunk_id(document: Column, text: Column) -> Column:
    """Document, underscore and twelve hex digits of the text's hash."""
    return F.concat(document, F.lit("_"), F.left(content_hash(identity_text(text)), F.lit(12)))


def document_of(chunk: Column) -> Column:
    """The document part of a chunk id in any of its three forms; the id itself if it has none."""
    forms = [r"^(.+)_[0-9a-f]{12}(?:-[0-9]+)?$", r"^(.+)_p[0-9]+_c[0-9]+$", r"^(.+)_c[0-9]+$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(chunk, f, 1), F.lit("")) for f in forms], chunk)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_.-]+", "_")


def keep_paragraphs(c: Column) -> Column:
    """Collapses blanks inside lines and more than one empty line."""
    one = F.regexp_replace(c, r"[ \t\xa0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r" ?\r?\n ?", "\n"), r"\n{3,}", "\n\n"))


def location(source_type: Column, page: Column, url: Column) -> Column:
    return F.when(F.upper(F.trim(source_type)) == "HTML", F.concat(F.lit("web page "), F.coalesce(url, F.lit("without address")))).when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))).otherwise("unknown place")


def unit_vector(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    wide = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)
