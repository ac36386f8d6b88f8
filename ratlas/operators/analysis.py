"""An analysis from its request to its article; the model is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratlas.functions import dates, jsonx, text
from ratlas.functions.text import as_text, filled
from ratlas.operators.jobs import transfer_mode, with_publication

#: Scopes, purposes and providers of a request; most characters of an excerpt and of a model's context.
SCOPES = ("session", "tops")
PURPOSES = ("content_analysis", "fact_extraction", "session_preparation", "journalistic_publication")
PROVIDERS = ("none", "claude", "codex", "ollama")
PURPOSE_LABELS = ("Inhaltsanalyse", "Strukturierte Faktenerfassung", "Sitzungsvorbereitung", "Journalistischer Publikationsentwurf")
EXCERPT = 12_000
CONTEXT = {"claude": 180_000, "codex": 100_000, "ollama": 24_000}


@dataclass(frozen=True)
class Request:
    session_id: str
    scope: str = "session"
    tops: tuple[str, ...] = ()
    provider: str = "none"
    purpose: str = "content_analysis"
    prompt: str = ""


def problems(request: Request, sessions: DataFrame, usable: DataFrame) -> list[str]:
    """What is wrong with a request; usable holds (session_id, number) of agenda items with local documents."""
    found = []
    if sessions.where(F.col("session_id") == request.session_id).isEmpty():
        found.append("unknown session")
    if request.scope not in SCOPES:
        found.append("unknown scope")
    if request.scope == "tops" and not request.tops:
        found.append("no agenda item chosen")
    elif request.scope == "tops":
        asked = sessions.sparkSession.createDataFrame([(t,) for t in request.tops], "number string")
        bad = asked.join(usable.where(F.col("session_id") == request.session_id), "number", "left_anti").orderBy("number").limit(len(request.tops)).collect()
        found += [f"no documents for {r.number}" for r in bad]
    if request.provider not in PROVIDERS:
        found.append("unknown provider")
    if request.purpose not in PURPOSES:
        found.append("unknown purpose")
    return found


def enriched(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (with resolved_path) with source_available, transfer_mode and excerpt, from files (path, text).

    Only texts that are shown travel. They are sorted, not broadcast: Spark can't tell their size before it has made them.
    """
    shown = F.when(transfer_mode(F.col("path")) == "text_excerpt", F.substring("text", 1, EXCERPT))
    f = files.select(F.col("path").alias("resolved_path"), shown.alias("__text"), F.lit(True).alias("__there")).hint("merge")
    df = documents.join(f, "resolved_path", "left").withColumn("source_available", F.coalesce("__there", F.lit(False)))
    mode = F.when(F.col("source_available"), transfer_mode(F.col("resolved_path"))).otherwise("metadata_only")
    return df.withColumn("transfer_mode", mode).withColumn("excerpt", F.when(mode == "text_excerpt", text.strip(as_text(F.col("__text")))).otherwise("")).drop("__text", "__there")


def _or(c: Column, default: str) -> Column:
    return F.coalesce(filled(c), F.lit(default))


def context_markdown(session: Column, agenda: Column, documents: Column, scope: str, tops: Sequence[str], prompt: Column, today: str) -> Column:
    """The text that goes to a model: the session, its agenda items in scope, the documents with their excerpts.

    session is a struct (date, committee, meeting_name), agenda an array of structs (number, title, status, decision),
    documents one of structs (agenda_item, document_type, title, source_available, transfer_mode, resolved_path, url,
    excerpt). Scope 'tops' without a choice shows no agenda item.
    """
    shown = F.filter(agenda, lambda i: i["number"].isin(*tops) if tops else F.lit(False)) if scope == "tops" else agenda
    items = F.transform(shown, lambda i: F.concat(F.lit("- "), _or(i["number"], "TOP"), F.lit(": "), _or(i["title"], "(ohne Titel)"), F.lit("\n  - Status: "), _or(i["status"], "-"), F.lit("\n  - Beschluss/Abstimmung: "), _or(i["decision"], "-")))
    excerpt = lambda d: F.when(as_text(d["excerpt"]) != "", F.concat(F.lit("\n  - Textauszug:\n    "), F.regexp_replace(d["excerpt"], r"\r\n|\r|\n", "\n    "))).otherwise("")
    sources = F.transform(
        documents,
        lambda d: F.concat(
            F.lit("- "), _or(d["agenda_item"], "-"), F.lit(" | "), _or(d["document_type"], "unbekannt"), F.lit(" | "), _or(d["title"], "(ohne Titel)"), F.lit(" | lokale Quelle: "),
            F.when(d["source_available"], "ja").otherwise("nein"), F.lit(" | KI-Übergabe: "), _or(d["transfer_mode"], "metadata_only"), F.lit("\n  - pfad: "), _or(d["resolved_path"], "-"), F.lit("\n  - url: "), _or(d["url"], "-"), excerpt(d),
        ),
    )
    day, committee = as_text(session["date"]), session["committee"]
    head = F.concat(
        F.lit("# Analyse Sitzung "), day, F.lit(" - "), _or(committee, "-"), F.lit("\n\n## Sitzungskontext\n- Sitzung: "), dates.session_state(day, today), F.lit("\n- Datum: "), _or(day, "-"), F.lit("\n- Gremium: "), _or(committee, "-"),
        F.lit("\n- Sitzungsname: "), _or(session["meeting_name"], "-"), F.lit(f"\n\n- Scope: {scope}\n- TOP-Auswahl: {'alle TOPs' if scope == 'session' else ', '.join(tops)}\n- Dokumente im Scope: "), F.size(documents).cast("string"),
        F.lit("\n\n## Analysehinweis\nDies ist nur eine lokal erzeugte Analysegrundlage. Die eigentliche Inhaltsanalyse soll über einen KI-Provider pro TOP erfolgen."),
    )
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n\n## {title}\n"), F.array_join(rows, "\n"))).otherwise("")
    return F.concat(head, part("TOP- und Abstimmungsinformationen", items), part("Quellen im Scope", sources), F.lit("\n\n## Prompt-Hinweis\n"), _or(prompt, "(kein Prompt gesetzt)"))


def answered(contexts: DataFrame, provider: Callable[[str, str], str] | None, name: str = "none", model: str = "") -> DataFrame:
    """contexts (job_id, context, prompt) with response, model_name, status and error_message.

    The provider runs where the rows are; what it raises becomes the row's error. Without one, jobs stay drafts. The
    prompt's own section is taken out of the context, which is cut to what the provider takes.
    """
    body = F.substring(F.regexp_replace(text.without_hint(F.col("context")), r"(?U)\s+$", ""), 1, CONTEXT.get(name, 180_000))
    df = contexts.withColumn("__body", body)
    if provider is None:
        return df.drop("__body").withColumns({"response": F.lit(""), "model_name": F.lit(model or name), "status": F.lit("draft"), "error_message": F.lit("")})

    @F.udf("struct<response:string,error:string>", useArrow=True)
    def ask(prompt: str, context: str):
        try:
            return {"response": provider(prompt, context), "error": None}
        except Exception as e:  # whatever a provider raises belongs to its row
            return {"response": "", "error": str(e)}

    df = df.withColumn("__a", ask("prompt", "__body"))
    failed = F.col("__a.error").isNotNull()
    return df.withColumns({"response": F.col("__a.response"), "model_name": F.lit(model or name), "status": F.when(failed, "error").otherwise("done"), "error_message": as_text(F.col("__a.error"))}).drop("__a", "__body")


def article() -> Column:
    """The article of a row that with_publication has seen: the publication if the answer has a body, else the context with
    the answer under it; a document's context holds it already."""
    published = (F.col("purpose") == "journalistic_publication") & (F.col("__obj") != "{}")
    plain = F.when((as_text(F.col("response")) != "") & (F.col("scope") != "document"), F.concat("markdown", F.lit("\n\n## KI-Analyse\n\n"), "response", F.lit("\n"))).otherwise(F.col("markdown"))
    return F.when(published & (F.col("__pub.body") != ""), F.col("__pub.markdown")).when(published, F.col("markdown")).otherwise(plain)


def articles(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, markdown, response, purpose, scope, meeting_name, committee) -> job_id, article."""
    return with_publication(jobs).select("job_id", article().alias("article"))
