"""Text expressions over columns: normalising, slugs, document types, decisions, labelled sections."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document types with the categories and the words that imply them, the earlier type first.
TYPE_CATEGORIES = {"protokoll": ("pr", "ni"), "bekanntmachung": ("bm", "be", "bek"), "beschlussvorlage": ("bv",), "vorlage": ("vo", "vl")}
TYPE_WORDS = ("protokoll", "bekanntmachung", "beschlussvorlage", "vorlage")
OTHER_TYPE = "sonstiges"
#: Words of a status that imply an outcome; the status is compared after umlauts are written out, so one
#: of them can never match.
ACCEPTED = ("beschlossen", "angenommen", "zugestimmt")
REJECTED = ("abgelehnt", "zurückgestellt", "vertagt", "ohne beschluss")
#: Labels that open a section and labels that end it, by type of document and field.
VORLAGE_SECTIONS = {
    "beschlusstext": (("Beschlussvorschlag", "Beschluss", "Empfehlung", "Antrag"), ("Begruendung", "Sachverhalt", "Finanzielle Auswirkungen", "Zustaendigkeit", "Federfuehrung", "Anlagen")),
    "begruendung": (("Begruendung", "Sachverhalt", "Erläuterung", "Erlaeuterung"), ("Finanzielle Auswirkungen", "Zustaendigkeit", "Federfuehrung", "Beschlussvorschlag", "Beschluss", "Anlagen")),
    "finanzbezug": (("Finanzielle Auswirkungen", "Finanzierung", "Haushaltsmittel", "Kosten"), ("Zustaendigkeit", "Federfuehrung", "Anlagen", "Beschluss", "Begruendung")),
    "zustaendigkeit": (("Zustaendigkeit", "Federfuehrung", "Beratungsfolge", "Zustaendige Stelle"), ("Anlagen", "Finanzielle Auswirkungen", "Begruendung", "Beschluss")),
}
PROTOKOLL_SECTIONS = {
    "entscheidung": (("Beschluss", "Abstimmung", "Entscheidung", "Ergebnis"), ("Begruendung", "Sachverhalt", "Notiz", "Hinweis", "Anlagen")),
    "beschlusstext": (("Beschlusstext", "Beschluss", "Beschlussvorschlag"), ("Abstimmung", "Ergebnis", "Notiz", "Hinweis", "Anlagen")),
    "begruendung": (("Begruendung", "Sachverhalt", "Diskussion", "Beratung"), ("Beschluss", "Abstimmung", "Ergebnis", "Anlagen")),
}
SECTIONS = {"vorlage": VORLAGE_SECTIONS, "beschlussvorlage": VORLAGE_SECTIONS, "protokoll": PROTOKOLL_SECTIONS}
#: Headings found on pages.
HEADINGS = ("Beschlussvorschlag", "Beschluss", "Begruendung", "Sachverhalt", "Finanzielle Auswirkungen", "Auswirkungen auf den Haushalt", "Anlagen", "Protokoll", "Ergebnis", "Empfehlung")
ANCHOR_CHARS = 180


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def as_text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The value, or null if it is empty."""
    return F.nullif(c, F.lit(""))


#: Fixed value: the characters that Unicode counts as white space.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_lines(c: Column) -> Column:
    """Line ends as LF, blanks and tabs as one blank, empty lines gone, stripped."""
    for signs, pattern, to in ((("\r",), r"\r\n?", "\n"), (("  ", "\t"), r"[ \t]+", " "), (("\n\n",), r"\n{2,}", "\n")):
        c = let(c, _replaced(signs, pattern, to))
    return strip(c)


def _replaced(signs: Sequence[str], pattern: str, to: str) -> Callable[[Column], Column]:
    """Replaces a pattern where a text holds one of the signs without which it can't match; most texts hold none."""
    return lambda x: F.when(contains_any(x, signs), F.regexp_replace(x, pattern, to)).otherwise(x)


def write_out_umlauts(c: Column) -> Column:
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(c, F.lit(w)) for w in words])


def decision(status: Column) -> Column:
    """accepted, rejected or null; accepting words are tested first, wherever they stand."""
    s = write_out_umlauts(F.lower(status))
    return F.when(contains_any(s, ACCEPTED), "accepted").when(contains_any(s, REJECTED), "rejected")


#: What parts a title from its reporter, and the marks cut off on either side of it.
REPORTER = r"(?:[-–—]\s*)?\bBerichterstatt[-\w()/]*:?\s*"


def title_and_reporter(text: Column) -> tuple[Column, Column]:
    """The title before the reporter's mark and the reporter after it (null if there is none)."""
    found = lambda t: F.rlike(t, F.lit(f"(?iu){REPORTER}"))
    head = lambda t: F.regexp_replace(F.regexp_extract(t, f"(?isu)^(.*?){REPORTER}", 1), r"[ \-–—,:;]+$", "")
    tail = lambda t: F.regexp_replace(F.regexp_extract(t, f"(?isu)^.*?{REPORTER}(.*)$", 1), r"^[ :;\-–—]+", "")
    title = let(collapse(text), lambda t: F.when(found(t), head(t)).otherwise(t))
    return title, let(collapse(text), lambda t: F.when(found(t), let(tail(t), filled)))


def file_slug(c: Column, most: int | None = None) -> Column:
    """Letters and digits kept, all else one hyphen; 'document' if nothing is left.

    Beyond `most` characters the slug is cut and ends in six digits of its hash, so that different names stay apart.
    """
    slug = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    slug = let(slug, lambda s: F.when(F.length(s) > 0, s).otherwise("document"))
    if most is None:
        return slug
    cut = lambda s: F.concat(F.regexp_replace(F.substring(s, 1, max(1, most - 7)), "-+$", ""), F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 6))
    return let(slug, lambda s: F.when(F.length(s) > most, cut(s)).otherwise(s))


@cache
def _ascii_forms() -> str:
    """What ASCII characters remain of each other character's compatibility decomposition, as a text that str_to_map takes."""
    left = ((chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode("ascii")) for i in range(0x80, sys.maxunicode + 1))
    return "\x02".join(f"{x}\x03{y}" for x, y in left if y)


def without_accents(c: Column) -> Column:
    """The ASCII characters of a text's compatibility decomposition. It decomposes each character by itself, so a table of
    characters gives the same; texts of ASCII, most of all, are left as they are."""
    forms = F.str_to_map(F.lit(_ascii_forms()), F.lit("\x02"), F.lit("\x03"))
    plain = lambda ch: F.when(ch <= "\x7f", ch).otherwise(F.coalesce(F.try_element_at(forms, ch), F.lit("")))
    return let(c, lambda x: F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(F.split(x, ""), plain), "")).otherwise(x))


def ascii_slug(c: Column, most: int = 30) -> Column:
    """Umlauts written out, accents dropped, ASCII letters and digits joined by hyphens, cut."""
    for x, y in (("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return F.substring(F.regexp_replace(F.regexp_replace(without_accents(write_out_umlauts(c)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def prompt_id_slug(c: Column) -> Column:
    """Lower case, umlauts written out, all else one underscore; 'prompt_vorlage' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(write_out_umlauts(F.lower(c)), r"(?U)[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.coalesce(filled(slug), F.lit("prompt_vorlage"))


def document_file_name(title: Column, url: Column, index: Column, extension: Column) -> Column:
    """slug-NNN-hash.ext: title, place (left out if null) and eight digits of the address's hash."""
    place = F.when(index.isNotNull(), F.lpad(index.cast("string"), 3, "0"))
    return F.concat(F.concat_ws("-", file_slug(F.coalesce(filled(title), F.lit("document")), 100), place, F.substring(F.sha1(url.cast("binary")), 1, 8)), extension)


def agenda_directory(number: Column, title: Column) -> Column:
    """number_title without its reporter, 120 characters at most."""
    return file_slug(F.concat_ws("_", filled(number), title_and_reporter(title)[0]), 120)


def humanize_committee(c: Column) -> Column:
    """A stored slug as words."""
    return collapse(F.regexp_replace(F.replace(c, F.lit("_"), F.lit("-")), "-+", " "))


def is_slug(c: Column) -> Column:
    return F.contains(F.btrim(as_text(c)), F.lit("-"))


#: Fixed value: the form of a session's folder name.
FOLDER = r"^(\d{4}-\d{2}-\d{2})[-_](.+)[-_](\d+)$"


def committee_from_path(path: Column) -> Column:
    """The committee's part of the last segment of a session path, as words; null if it has another form."""
    return filled(humanize_committee(F.regexp_extract(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), FOLDER, 2)))


def document_type(title: Column, category: Column, content_type: Column, url: Column, path: Column) -> Column:
    """The type that a category names, else the first that any of the texts mentions, else 'sonstiges'."""
    code = F.lower(F.btrim(as_text(category)))
    text = F.lower(F.concat_ws(" ", *[as_text(c) for c in (title, category, content_type, url, path)]))
    out = None
    for name, codes in TYPE_CATEGORIES.items():
        out = (out.when if out is not None else F.when)(code.isin(*codes), name)
    for name in TYPE_WORDS:
        out = out.when(F.contains(text, F.lit(name)), name)
    return out.otherwise(OTHER_TYPE)


def any_of(names: Sequence[str]) -> str:
    """A pattern of names as whole words. Their first letters are asked for before anything else: most places have none."""
    first = {x for n in names for x in (n[0].upper(), n[0].lower())}
    first |= {y for x, y in (("s", "\u017f"), ("k", "\u212a")) if x in first}  # what else folds to these letters
    return rf"(?-iu:(?=[{''.join(sorted(first))}]))\b(?:{'|'.join(names)})\b"


def _between(text: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    rest = F.regexp_extract(text, rf"(?isu){any_of(labels)}\s*[:\-]?\s*(.*)", 1)
    return F.get(F.split(rest, f"(?iu){any_of(stops)}", 2), F.lit(0))


def labelled_section(text: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    """What follows the first label, up to the first label that ends it; null if there is no label or nothing follows."""
    return filled(normalize_lines(_between(text, labels, stops)))


def section_list(text: Column, kind: str) -> Column:
    """The sections that a document of this type has, as an array of (name, value) without those that are missing; the
    text's lines are in order already."""
    found = F.array(*[F.struct(F.lit(name).alias("name"), strip(_between(text, labels, stops)).alias("value")) for name, (labels, stops) in SECTIONS[kind].items()])
    return F.filter(found, lambda x: x["value"] != "")  # nullif would take each section out twice


def section_fields(text: Column, kind: str) -> Column:
    """A map of the fields that a document of this type has."""
    return let(section_list(normalize_lines(text), kind), F.map_from_entries)


def parse_content(kind: Column, text: Column, title: Column) -> Column:
    """A struct of status, quality, fields (map) and sections (their names, sorted) for any document.

    Only three types have sections. The title is a field too, and makes a parse succeed, but says nothing of quality. The
    text is put in order once and each of its sections is taken out once; all else is read off the list of sections.
    """
    kind, name = F.lower(F.btrim(as_text(kind))), F.btrim(as_text(title))
    none = F.expr("cast(array() as array<struct<name:string,value:string>>)")

    def sections(body: Column) -> Column:
        out = none
        for layout in (VORLAGE_SECTIONS, PROTOKOLL_SECTIONS):  # types that share a layout share its extraction
            kinds = [k for k, v in SECTIONS.items() if v is layout]
            out = F.when(kind.isin(*kinds), section_list(body, kinds[0])).otherwise(out)
        return F.struct(F.length(body).alias("n"), F.when(body != "", out).otherwise(none).alias("found"))

    def result(x: Column) -> Column:
        n, found, supported = x["n"], x["found"], kind.isin(*SECTIONS)
        usable, hits, titled = supported & (n > 0), F.size(x["found"]), name != ""
        fields = F.map_from_entries(F.when(usable & titled, F.concat(found, F.array(F.struct(F.lit("titel").alias("name"), name.alias("value"))))).otherwise(found))
        some = (hits > 0) | (usable & titled)
        status = F.when(~supported, "unsupported_document_type").when(n == 0, "empty_text").when(some, "ok").otherwise("no_structured_fields")
        quality = F.when(~usable, "failed").when(hits >= 3, "high").when(hits >= 2, "medium").when(some | (n >= 120), "low").otherwise("failed")
        return F.struct(status.alias("status"), quality.alias("quality"), fields.alias("fields"), F.sort_array(found["name"]).alias("sections"))

    return let(let(normalize_lines(as_text(text)), sections), result)


def section_headings(text: Column) -> Column:
    """array<struct<heading, anchor_text>>: every heading with a colon, and the 180 characters from it on.

    What follows a heading is matched without being passed over, so that near headings have it too; a text is searched
    twice, however many headings it has.
    """
    pattern = F.lit(rf"(?is)(?=[{''.join(sorted({h[0] for h in HEADINGS}))}])((?:{'|'.join(HEADINGS)})\s*:)(?=(.{{0,{ANCHOR_CHARS}}}))")
    hits = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("head"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("tail"))
    anchor = lambda x: collapse(F.substring(F.concat(x["head"], x["tail"]), 1, ANCHOR_CHARS))
    return F.transform(hits, lambda x: F.struct(F.btrim(F.regexp_replace(x["head"], r"\s*:$", "")).alias("heading"), anchor(x).alias("anchor_text")))


def text_quality(text: Column, most: int, is_pdf: Column) -> Column:
    """A struct of status, quality, text, chars and ocr_needed for extracted text, by its length."""
    body = F.substring(collapse(as_text(text)), 1, most)
    n = F.length(body)
    status = F.when((n == 0) & is_pdf, "ocr_needed").when(n == 0, "empty_text").when(n < 80, "partial").otherwise("ok")
    quality = F.when((n == 0) & ~is_pdf, "failed").when(n < 80, "low").when(n < 500, "medium").otherwise("high")
    return F.struct(status.alias("status"), quality.alias("quality"), body.alias("text"), n.alias("chars"), ((n == 0) & is_pdf).alias("ocr_needed"))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced by its value (null: empty), once: what a value holds is not expanded. Names that aren't given
    stay as they are."""
    if not values:
        return template
    pattern = r"\{\{\s*(" + "|".join(sorted(map(re.escape, values), key=len, reverse=True)) + r")\s*\}\}"
    given = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), as_text(v.cast("string")))])
    names = F.regexp_extract_all(template, F.lit(pattern), F.lit(1))
    return F.array_join(F.transform(F.split(template, pattern, -1), lambda x, i: F.concat(x, F.coalesce(F.try_element_at(given, F.get(names, i)), F.lit("")))), "")


def score_text(score: Column) -> Column:
    """A fused score with four decimals."""
    return F.format_string("%.4f", score)


def megabytes(size: Column) -> Column:
    """Bytes as MB of 1024 * 1024 bytes, in one decimal."""
    return F.round(size / (1 << 20), 1)


def placeholders(template: Column) -> Column:
    """The distinct names in {{ }}, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"), F.lit(1)))


def variables(c: Column) -> Column:
    """A list written with commas or line ends, as an array without blanks."""
    return F.filter(F.transform(F.split(as_text(c), "[,\n]"), lambda x: F.btrim(x)), lambda x: x != "")


def without_hint(markdown: Column) -> Column:
    """Markdown without its closing section of hints for the prompt."""
    return F.regexp_replace(markdown, r"(?s)\n## Prompt-Hinweis\n.*$", "")


def pages_in_order(names: Column) -> Column:
    """Names of page images in the order of their numbers; names without one come last, by name."""
    place = lambda n: F.coalesce(F.regexp_extract(n, r"page-(\d+)\.png$", 1).try_cast("long"), F.lit(10**9))
    return F.transform(F.array_sort(F.transform(names, lambda n: F.struct(place(n).alias("place"), n.alias("name")))), lambda x: x["name"])
