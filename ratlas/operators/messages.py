"""What is sent to a model, as columns: texts and content blocks built from prompt, context and PDFs; and who is asked."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratlas.functions.text import as_text, filled
from ratlas.operators.analysis import CONTEXT, PROVIDERS

#: The labels of providers, the headings of a message, what stands for a PDF that can't be read, and the line
#: that one provider's message begins with.
PROVIDER_LABELS = {"none": "Kein Provider (nur Grundlage)", "claude": "Claude (Anthropic)", "codex": "Codex (OpenAI)", "ollama": "Ollama (lokal)"}
BASIS, TASK, PDF = "## Analysegrundlage\n\n", "## Analyseauftrag\n\n", "\n\n### PDF: "
NO_TEXT, UNREADABLE = "[Text nicht extrahierbar]", "[PDF nicht lesbar: "
FIRST_LINE = {"ollama": "Du analysierst kommunalpolitische Dokumente. Antworte auf Deutsch.\n\n"}

Provider = Callable[[str, str], str]


def provider(name: str, registry: Mapping[str, Provider]) -> Provider:
    """The function that answers for a provider; ValueError for an unknown one, for 'none', and for one that isn't set up."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(PROVIDERS)}")
    if name == "none":
        raise ValueError("'none' stands for no provider")
    if name not in registry:
        raise ValueError(f"provider {name!r} is not set up")
    return registry[name]


def with_pdf_text(context: Column, pdfs: Column) -> Column:
    """A context with the texts of PDFs under it; pdfs is an array of structs (name, text) in their order."""
    parts = F.transform(pdfs, lambda p: F.concat(F.lit(PDF), p["name"], F.lit("\n\n"), F.coalesce(filled(p["text"]), F.lit(NO_TEXT))))
    return F.concat(as_text(context), F.coalesce(F.array_join(parts, ""), F.lit("")))


def user_message(name: str, prompt: Column, context: Column) -> Column:
    """The text that a provider gets; the context is cut to what it takes."""
    return F.concat(F.lit(FIRST_LINE.get(name, "") + BASIS), F.substring(as_text(context), 1, CONTEXT[name]), F.lit("\n\n" + TASK), as_text(prompt))


def content_blocks(name: str, prompt: Column, context: Column, pdfs: Column) -> Column:
    """A message with PDFs as JSON blocks; null without any, as the text is sent alone then. pdfs is an array of structs
    (name, content); one without content is named as unreadable. base64 lines aren't broken."""
    source = lambda p: F.struct(F.lit("base64").alias("type"), F.lit("application/pdf").alias("media_type"), F.regexp_replace(F.base64(p["content"]), "[\r\n]", "").alias("data"))
    none = F.lit(None).cast("struct<type:string,media_type:string,data:string>")
    text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), none.alias("source"))
    document = lambda p: F.struct(F.lit("document").alias("type"), F.lit(None).cast("string").alias("text"), source(p).alias("source"))
    files = F.transform(pdfs, lambda p: F.when(p["content"].isNull(), text(F.concat(F.lit(UNREADABLE), p["name"], F.lit("]")))).otherwise(document(p)))
    body = F.substring(as_text(context), 1, CONTEXT[name])
    first = F.filter(F.array(text(F.concat(F.lit(BASIS), body))), lambda _: body != "")
    return F.when(F.coalesce(F.size(pdfs), F.lit(0)) > 0, F.to_json(F.concat(first, files, F.array(text(F.concat(F.lit(TASK), as_text(prompt)))))))
