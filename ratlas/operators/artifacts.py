"""Analysis jobs as files and rows: scanning artifacts, building a job's outputs, its states, and a whole run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratlas.functions import jsonx
from ratlas.functions.text import as_text, ascii_slug, filled, let, strip
from ratlas.operators import analysis
from ratlas.operators.jobs import answer_field, job_stem, with_publication

#: The form of a job's file name; the keys that a JSON artifact lays over its job; folders that stay private.
JOB = r"(?i)job[_-]([\w.-]+)"
KEYS = (
    "created_at", "session_id", "scope", "purpose", "model_name", "prompt_version", "prompt_template_id", "prompt_template_revision", "prompt_template_label",
    "rendered_prompt_snapshot_path", "prompt_text", "markdown", "ki_response", "status", "error_message", "session_date", "session_path", "output_type", "schema_version",
)
PRIVATE = ("data/private",)


def job_of(path: Column) -> Column:
    """The job's id in a file name, up to its first dot; null if there is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return filled(F.split_part(F.regexp_extract(stem, JOB, 1), F.lit("."), F.lit(1)))


def is_private(path: Column, snapshot: Column, roots: Sequence[str] = PRIVATE) -> Column:
    """Whether a source is the job's own prompt snapshot or lies in a private folder."""
    p, s = F.replace(as_text(path), F.lit("\\"), F.lit("/")), F.replace(as_text(snapshot), F.lit("\\"), F.lit("/"))
    inside = F.lit(False)
    for r in roots:
        inside = inside | (p == r) | F.startswith(p, F.lit(f"{r}/"))
    return (p != "") & (((s != "") & (p == s)) | inside)


def scan(files: DataFrame, prompt_root: str = "data/private/analysis_prompts") -> DataFrame:
    """files (path, content) -> one row a job: what its JSON artifacts say, its files, and warnings.

    Files are read in the order of their paths; a later value that isn't empty overwrites an earlier one. A JSON file that
    can't be read is a warning. Markdown and, below the prompt root, text files fill what JSON leaves empty; so does the
    body of a publication. Private files and the prompt's snapshot are left out of the list, which is sorted and unique.
    """
    df = files.withColumn("job_id", job_of(F.col("path"))).where("job_id IS NOT NULL")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    obj = F.when((ext == ".json") & F.try_parse_json(F.col("content")).isNotNull(), F.col("content"))
    df = df.withColumns({"__obj": obj, "__bad": (ext == ".json") & obj.isNull(), "__md": F.when(ext == ".md", F.col("content")), "__txt": F.when((ext == ".txt") & F.startswith(F.col("path"), F.lit(f"{prompt_root}/")), strip(F.col("content")))})
    names = (*KEYS, "body_markdown")
    df = df.select("*", F.json_tuple("__obj", *names).alias(*[f"__{k}" for k in names]))  # one reading for all of them
    df = df.withColumns({f"__{k}": F.nullif(filled(F.col(f"__{k}")), F.lit("[]")) for k in names})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("path")))
    first = lambda c: F.min_by(c, F.when(filled(F.col(c)).isNotNull(), F.col("path")))
    jobs = df.groupBy("job_id").agg(
        *[last(f"__{k}").alias(k) for k in KEYS], first("__body_markdown").alias("__body"), first("__md").alias("__first"), last("__txt").alias("__prompt"),
        F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set(F.when(F.col("__bad"), F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" konnte nicht gelesen werden."))))).alias("warnings"),
    )
    jobs = jobs.withColumn("markdown", F.coalesce("markdown", "__body", "__first")).withColumn("prompt_text", F.coalesce("prompt_text", "__prompt"))
    shown = F.filter("files", lambda x: ~is_private(x, F.col("rendered_prompt_snapshot_path")))
    content = F.coalesce(filled(F.col("markdown")), filled(F.col("ki_response")), filled(F.col("prompt_text"))).isNotNull()
    return jobs.withColumn("files", shown).withColumn("has_content", content).drop("__body", "__first", "__prompt")


def output_rows(outputs: DataFrame) -> DataFrame:
    """Stored outputs of either layout: content inline, or a path; neither gives no rows."""
    kinds = {"job_id": "string", "output_format": "string", "content": "string", "output_type": "string", "output_path": "string"}
    if not {"content", "output_path"} & set(outputs.columns):
        return outputs.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return outputs.select(*[(F.col(c) if c in outputs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _with_raw(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    text = [as_text(F.col(c)).alias(c) for c in ("title", "document_type", "agenda_item", "url", "local_path")]
    per = documents.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", *text, F.coalesce("source_available", F.lit(False)).alias("source_available")))).alias("__d"))
    names = ("title", "document_type", "agenda_item", "url", "local_path", "source_available")
    docs = F.transform(F.coalesce("__d", F.expr("array()")), lambda x: F.struct(*[x[c].alias(c) for c in names]))
    raw = F.to_json(F.struct("job_id", "session_id", "scope", F.col("tops").alias("top_numbers"), docs.alias("documents"), "source_db", "session_path", "created_at"))
    return jobs.join(per, "job_id", "left").withColumn("__raw", raw).drop("__d")


def raw_outputs(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """job_id and the raw analysis as JSON: what the job asked for and its documents (with job_id, id and
    source_available) in the order of their ids."""
    return _with_raw(jobs, documents).select("job_id", F.col("__raw").alias("value"))


def structure() -> list[Column]:
    """topic, open_questions and risks of a row that with_publication has seen: from the answer's JSON, the job's error
    among the risks."""
    none = F.expr("cast(array() as array<string>)")
    first = lambda *names: F.coalesce(*[let(jsonx.text_list(answer_field(f"$.{n}")), lambda x: F.when(F.size(x) > 0, x)) for n in names], none)
    topic = F.coalesce(*[filled(answer_field(f"$.{n}")) for n in ("title", "topic")], filled(F.col("meeting_name")), filled(F.col("committee")), F.lit(""))
    error = F.when(as_text(F.col("error_message")) != "", F.array("error_message")).otherwise(none)
    return [topic.alias("topic"), first("open_questions", "missing_information").alias("open_questions"), F.concat(first("source_notes", "contradictions"), error).alias("risks")]


def structured_outputs(jobs: DataFrame) -> DataFrame:
    """job_id, topic, open_questions, risks."""
    return with_publication(jobs).select("job_id", *structure())


def slug() -> Column:
    """The slug of a publication of a row that with_publication has seen: the session's date, or the job's, and the title."""
    day = F.btrim(F.coalesce(filled(F.col("session_date")), F.substring("created_at", 1, 10)))
    return F.lower(ascii_slug(F.concat(day, F.lit("-"), F.coalesce(filled(F.col("__pub.title")), F.col("session_id")))))


def slugs(jobs: DataFrame) -> DataFrame:
    """job_id and the slug of its publication."""
    return with_publication(jobs).select("job_id", slug().alias("slug"))


def fan_out(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """job_id, name, content: a done or failed job's files. Article, raw and structured analysis always, the answer if
    there is one, a publication for journalistic purposes, the prompt and the article's copy as the latest. All of it
    comes from the job's own row, which meets its documents in one join."""
    df = with_publication(_with_raw(jobs, documents)).withColumn("__stem", job_stem(F.col("job_id"), F.col("scope"), F.col("tops"), F.col("model_name"))).withColumn("__slug", slug())
    topic, questions, risks = structure()
    formed = F.to_json(F.struct("job_id", F.struct(topic.alias("title")).alias("topic"), questions, risks.alias("risks_or_uncertainties")))
    pub = [F.col(f"__pub.{c}") for c in ("title", "summary_short", "summary_long")]
    draft = F.to_json(F.struct("job_id", *pub, F.col("__pub.markdown").alias("body_markdown"), F.col("__slug").alias("slug")))
    answer = F.when(as_text(F.col("response")) != "", F.to_json(F.struct("job_id", "response")))
    public = F.when((F.col("purpose") == "journalistic_publication") & (F.col("status") == "done"), draft)
    parts = {".article.md": analysis.article(), ".raw.json": F.col("__raw"), ".structured.json": formed, ".ki_response.json": answer, ".publication.json": public, ".prompt.txt": filled(F.col("prompt"))}
    df = df.select("job_id", "__stem", *[c.alias(f"__{end}") for end, c in parts.items()])
    files = [F.struct(F.concat(F.col("__stem"), F.lit(end)).alias("name"), F.col(f"`__{end}`").alias("content")) for end in parts]
    files.append(F.struct(F.lit("latest.md").alias("name"), F.col("`__.article.md`").alias("content")))
    return df.select("job_id", F.explode(F.array(*files)).alias("f")).select("job_id", "f.*").where("content IS NOT NULL")


def current_states(events: DataFrame) -> DataFrame:
    """events (job_id, at, status, error_message): jobs are only added to; a job's state is its latest event, ties by
    status."""
    return events.groupBy("job_id").agg(F.max(F.struct("at", "status", "error_message")).alias("e")).select("job_id", "e.*")


def run(contexts: DataFrame, documents: DataFrame, provider: Callable[[str, str], str] | None, name: str = "none", model: str = "") -> tuple[DataFrame, DataFrame]:
    """A whole analysis: contexts (job_id, context, prompt and the columns of a job) -> jobs with answer and status, and
    their files. Save the jobs before reading the files, so that the provider is asked once."""
    jobs = analysis.answered(contexts, provider, name, model).withColumn("markdown", F.col("context"))
    return jobs, fan_out(jobs, documents)
