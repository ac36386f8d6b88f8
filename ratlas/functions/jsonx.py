"""JSON that comes from models, people and older versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratlas.functions.text import as_text, filled, let, strip

EMPTY = "{}"


def response_object(text: Column) -> Column:
    """The JSON object in a model's answer, with or without a fence around it, as text; '{}' for anything else."""
    fenced = lambda t: strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))
    inner = let(strip(as_text(text)), lambda t: F.when(F.startswith(t, F.lit("```")), fenced(t)).otherwise(t))
    return let(inner, lambda t: F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t).otherwise(EMPTY))


def at(obj: Column, path: str) -> Column:
    """The value at a path as text; null if it is missing, empty or null."""
    return filled(F.get_json_object(obj, path))


def publication_parts(read: Callable[[str], Column], meeting_name: Column, committee: Column) -> Column:
    """Struct of title, subtitle, intro, body, by a function from a path to the answer's value there: fields of the article
    come before those of the answer."""
    own = lambda name, inner: F.coalesce(filled(read(f"$.article.{inner}")), filled(read(f"$.{name}")))
    title = F.coalesce(own("title", "title"), filled(meeting_name), filled(committee), F.lit("Analyseentwurf"))
    return F.struct(title.alias("title"), as_text(own("subtitle", "subtitle")).alias("subtitle"), as_text(own("intro", "teaser")).alias("intro"), as_text(own("body", "body_markdown")).alias("body"))


SOURCES = "array<struct<title:string,document_type:string,url:string>>"


def publication_sources(read: Callable[[str], Column]) -> Column:
    """The sources as an array of structs; members that aren't objects are null but keep their place."""
    raw = F.coalesce(read("$.sources"), read("$.article.sources"))
    members = F.coalesce(F.from_json(raw, "array<string>"), F.expr("cast(array() as array<string>)"))
    return F.transform(members, lambda m: F.when(F.startswith(F.ltrim(m), F.lit("{")), F.from_json(m, "title string, document_type string, url string")))


def publication_markdown(parts: Column, sources: Column) -> Column:
    """Title, subtitle, introduction, body and numbered sources, parted by blank lines."""
    lines = F.transform(
        sources,
        lambda s, i: F.when(
            s.isNotNull(),
            F.concat(
                (i + 1).cast("string"), F.lit(". "), F.coalesce(filled(s["title"]), F.lit("Quelle")),
                F.coalesce(F.concat(F.lit(" ("), filled(s["document_type"]), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" - "), filled(s["url"])), F.lit("")),
            ),
        ),
    )
    head = F.array(F.concat(F.lit("# "), filled(parts["title"])), F.concat(F.lit("**"), filled(parts["subtitle"]), F.lit("**")), filled(parts["intro"]), filled(parts["body"]))
    tail = F.when(F.size(sources) > 0, F.concat(F.array(F.lit("## Quellen")), lines)).otherwise(F.expr("cast(array() as array<string>)"))
    return strip(F.array_join(F.concat(head, tail), "\n\n"))


def tolerant_bool(value: Column, default: bool = True) -> Column:
    """A boolean written as a word or digit; null is the default, any other text that isn't empty is true."""
    v = F.lower(F.btrim(value.cast("string")))
    words = F.when(v.isin("1", "true", "yes", "on", "active", "aktiv"), True).when(v.isin("0", "false", "no", "off", "inactive", "inaktiv"), False)
    return words.when(value.isNull(), default).otherwise(F.length(value.cast("string")) > 0)


def tolerant_int(value: Column, default: int = 1) -> Column:
    """A whole number of 1 or more."""
    n = F.btrim(value.cast("string")).try_cast("int")
    return F.when(n >= 1, n).otherwise(default)


def scope_list(scopes: Column, scope: Column) -> Column:
    """The scopes of a list and a single field together, without blanks and repeats, in order."""
    one = F.when(F.btrim(as_text(scope)) != "", F.array(F.btrim(scope))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(scopes, F.expr("cast(array() as array<string>)")), one), lambda x: F.btrim(x)), lambda x: x != ""))


def member_list(json: Column, key: str, schema: str) -> Column:
    """The objects of a bare list, or of the list at `key` of an object; anything else is an empty list."""
    t = F.ltrim(as_text(json))
    raw = F.when(F.startswith(t, F.lit("[")), t).otherwise(F.get_json_object(t, f"$.{key}"))
    members = F.filter(F.coalesce(F.from_json(raw, "array<string>"), F.expr("cast(array() as array<string>)")), lambda m: F.startswith(F.ltrim(m), F.lit("{")))
    return F.transform(members, lambda m: F.from_json(m, schema))


def normalize_output(df, version: str = "schema_version"):
    """Records of version 2 as they are, older ones marked as legacy: adds output_generation."""
    return df.withColumn("output_generation", F.when(F.startswith(as_text(F.col(version)), F.lit("2")), "v2").otherwise("legacy"))


def text_list(json: Column) -> Column:
    """A JSON value as an array of texts: a list's members, a single value as one; null, empty, false and 0 as none."""
    none = F.expr("cast(array() as array<string>)")
    one = lambda j: F.when(j.isin("", "null", "false", "0", '""', "[]", "{}"), none).otherwise(F.array(j))
    return let(F.btrim(as_text(json)), lambda j: F.coalesce(F.when(F.startswith(j, F.lit("[")), F.from_json(j, "array<string>")), one(j)))


def tops_json(tops: Column) -> Column:
    """Chosen agenda items as a JSON list; none or null: []."""
    return F.coalesce(F.to_json(tops), F.lit("[]"))
