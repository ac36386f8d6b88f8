"""Analysis jobs: merging their sources, their outputs, logs and artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratlas.functions import jsonx
from ratlas.functions.text import as_text, ascii_slug, filled

#: Most lines of a log's tail, most ended jobs that are kept.
TAIL, RETAINED = 500, 50
#: The fields of an answer's JSON that anything reads.
FIELDS = ("title", "topic", "subtitle", "intro", "body", "sources", "article", "open_questions", "missing_information", "source_notes", "contradictions")
SCALARS = ("created_at", "session_id", "scope", "purpose", "model_name", "status", "markdown")


def namespaced(jobs: DataFrame, source: str) -> DataFrame:
    """Rows of one store under ids that can't meet those of another: source:id."""
    return jobs.select(F.concat(F.lit(f"{source}:"), F.col("id").cast("string")).alias("job_id"), F.col("id").cast("string").alias("db_job_id"), F.lit(source).alias("source"), F.lit({"workflow": 0, "local": 1}.get(source, 2)).alias("place"), *[(F.col(c) if c in jobs.columns else F.lit(None)).cast("string").alias(c) for c in SCALARS])


def resolve_files(file_jobs: DataFrame, db_jobs: DataFrame) -> DataFrame:
    """File jobs (id, source, ...) under the id of the stored job they belong to.

    One stored job with their number: that one. Several: the only one that shares a source, else the only one of the
    workflow. Else their own number.
    """
    per = db_jobs.groupBy("db_job_id").agg(F.collect_set(F.struct("job_id", "source")).alias("m"))
    df = file_jobs.withColumn("db_job_id", F.col("id").cast("string")).join(per, "db_job_id", "left")
    m = F.coalesce("m", F.expr("cast(array() as array<struct<job_id:string,source:string>>)"))
    only = lambda a: F.when(F.size(a) == 1, F.element_at(a, 1)["job_id"])
    shared = F.filter(m, lambda x: x["source"] == F.col("source"))
    flow = F.filter(m, lambda x: F.startswith(x["job_id"], F.lit("workflow:")))
    name = F.coalesce(only(m), only(shared), only(flow), F.col("db_job_id"))
    return df.select(name.alias("job_id"), "db_job_id", "source", F.lit(9).alias("place"), *[(F.col(c) if c in file_jobs.columns else F.lit(None)).cast("string").alias(c) for c in SCALARS])


def merge(*parts: DataFrame) -> DataFrame:
    """One row a job: the first value that isn't empty by place of its source, and all sources, the latest job first."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = lambda c: as_text(F.min_by(F.when(as_text(F.col(c)) != "", F.col(c)), F.when(as_text(F.col(c)) != "", F.struct("place", c)))).alias(c)
    df = union.groupBy("job_id").agg(F.max("db_job_id").alias("db_job_id"), F.array_sort(F.collect_set("source")).alias("sources"), *[first(c) for c in SCALARS])
    return df.orderBy(F.coalesce(filled(F.col("created_at")), F.col("job_id")).desc(), "job_id")


def find(jobs: DataFrame, job_id: str) -> DataFrame:
    """The job of this id; else the only stored job of this number; else nothing."""
    exact = jobs.where(F.col("job_id") == job_id)
    by_number = jobs.where(F.col("db_job_id") == job_id).withColumn("__n", F.count("*").over(Window.partitionBy("db_job_id"))).where("__n = 1").drop("__n")
    return exact.unionByName(by_number.join(exact.select(F.lit(1).alias("__x")).limit(1), F.lit(True), "left_anti")).limit(1)


def outputs_by_job(outputs: DataFrame) -> DataFrame:
    """The outputs of each job in the order of their ids: their formats, and the first content of each format."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "output_format", "content")))
    df = outputs.groupBy("job_id").agg(ordered.alias("o"))
    pick = lambda f: F.get(F.filter("o", lambda x: (x["output_format"] == f) & (as_text(x["content"]) != "")), F.lit(0))["content"]
    return df.select("job_id", F.col("o.output_format").alias("formats"), pick("markdown").alias("markdown"), pick("json").alias("json"))


def log_tail(lines: DataFrame, job: str, order: str, most: int = TAIL) -> DataFrame:
    """The last lines of each job in their order."""
    last = F.row_number().over(Window.partitionBy(job).orderBy(F.col(order).desc()))
    return lines.withColumn("__i", last).where(F.col("__i") <= most).drop("__i").orderBy(job, order)


def retained(jobs: DataFrame, ended: Column, order: str, most: int = RETAINED) -> DataFrame:
    """Jobs that still run, and the latest that ended."""
    last = jobs.where(ended).orderBy(F.col(order).desc()).limit(most)
    return jobs.where(~ended).unionByName(last)


def answer_field(path: str) -> Column:
    """The value at a path of the answer of a row that with_publication reads; what lies below a field is looked up only
    where the answer has the field."""
    name = path.split(".")[1]
    return F.col(f"__in_{name}") if path == f"$.{name}" else F.when(F.col(f"__in_{name}").isNotNull(), F.get_json_object("__obj", path))


def with_publication(responses: DataFrame) -> DataFrame:
    """responses (response, meeting_name, committee) with __obj, the answer's JSON, its fields (__in_title, ...), which one
    reading takes, and __pub, a struct of title, subtitle, intro, body, markdown and summaries. All are worked out once,
    whatever reads them."""
    obj = F.explode(F.array(jsonx.response_object(F.col("response")))).alias("__obj")  # no condition moves below a generator
    df = responses.select("*", obj).select("*", F.json_tuple("__obj", *FIELDS).alias(*[f"__in_{n}" for n in FIELDS]))
    df = df.withColumn("__p", jsonx.publication_parts(answer_field, F.col("meeting_name"), F.col("committee")))
    p = F.col("__p")
    short = F.coalesce(filled(p["subtitle"]), F.substring(p["intro"], 1, 240))
    long = F.coalesce(filled(p["intro"]), F.substring(p["body"], 1, 1000))
    pub = F.struct(*[p[c].alias(c) for c in ("title", "subtitle", "intro", "body")], jsonx.publication_markdown(p, jsonx.publication_sources(answer_field)).alias("markdown"), short.alias("summary_short"), long.alias("summary_long"))
    return df.withColumn("__pub", pub).drop("__p")


def publications(responses: DataFrame) -> DataFrame:
    """responses (job_id, response, meeting_name, committee) -> title, subtitle, intro, body, markdown, and summaries."""
    return with_publication(responses).select("job_id", "__pub.*")


def workflow_outputs(jobs: DataFrame) -> DataFrame:
    """The rows that a done job adds to the workflow's outputs: raw, structured and article, and a publication for
    journalistic purposes."""
    kinds = F.array(*[F.struct(F.lit(t).alias("output_type"), F.lit(f).alias("output_format")) for t, f in (("raw_analysis", "json"), ("structured_analysis", "json"), ("journalistic_article", "markdown"))])
    draft = F.array(F.struct(F.lit("publication_draft").alias("output_type"), F.lit("json").alias("output_format")))
    all_ = F.when((F.col("purpose") == "journalistic_publication") & (F.col("status") == "done"), F.concat(kinds, draft)).otherwise(kinds)
    return jobs.select("job_id", F.posexplode(all_).alias("place", "k")).select("job_id", "place", "k.output_type", "k.output_format")


def job_stem(job_id: Column, scope: Column, tops: Column, model: Column) -> Column:
    """job_<id>-<scope>-<up to three items or all>-<model>, from three columns of items' slugs at most."""
    slugs = [ascii_slug(F.get(F.filter(tops, lambda t: as_text(t) != ""), F.lit(i))) for i in range(3)]
    return F.concat(F.lit("job_"), job_id.cast("string"), F.lit("-"), scope, F.lit("-"), F.coalesce(filled(F.concat_ws("-", *slugs)), F.lit("all")), F.lit("-"), F.coalesce(filled(ascii_slug(as_text(model))), F.lit("none")))


def transfer_mode(path: Column) -> Column:
    """How a document goes to a model: as metadata, as a PDF, or as an excerpt of its text."""
    p = F.lower(as_text(path))
    text = reduce(lambda a, b: a | b, [F.endswith(p, F.lit(s)) for s in (".txt", ".md", ".markdown", ".html", ".htm")])
    return F.when(F.endswith(p, F.lit(".pdf")), "pdf_attachment").when(text, "text_excerpt").otherwise("metadata_only")


def active(jobs: DataFrame) -> DataFrame:
    """Jobs that wait or run."""
    return jobs.where(F.col("status").isin("queued", "running"))


def latest(jobs: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The newest jobs, the newest first."""
    return jobs.orderBy(F.col(order).desc_nulls_last(), "job_id").limit(most)


def document_outputs(answers: DataFrame) -> DataFrame:
    """Answers on single documents (job_id, title, agenda_item, document_type, quality, chars, model_name, response) as
    stored outputs: job_id, place, output_format, content. The answer alone is a second output unless it is empty."""
    t = lambda c: as_text(F.col(c).cast("string"))
    # fixed text: the form of the report on a document
    report = F.concat(
        F.lit("# Dokument-Analyse: "), t("title"), F.lit("\n\n- TOP: "), t("agenda_item"), F.lit("\n- Typ: "), t("document_type"), F.lit("\n- Extraktionsqualitaet: "), t("quality"), F.lit(" ("), t("chars"), F.lit(" Zeichen)\n- Modell: "), t("model_name"),
        F.lit("\n\n## KI-Antwort\n\n"), t("response"),
    )
    both = F.array(F.struct(F.lit("markdown").alias("output_format"), report.alias("content")), F.struct(F.lit("ki_response").alias("output_format"), t("response").alias("content")))
    return answers.select("job_id", F.posexplode(F.filter(both, lambda x: (x["output_format"] == "markdown") | (x["content"] != ""))).alias("place", "o")).select("job_id", "place", "o.*")
