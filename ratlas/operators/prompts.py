"""Prompt templates: reading, checking, revising and choosing them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas import schemas
from ratlas.functions import jsonx, text
from ratlas.functions.text import as_text
from ratlas.sources import sinks

#: Names that a template may use, its scopes and visibilities.
ALLOWED = ("session_title", "session_date", "committee", "agenda_item", "document_text", "source_list", "analysis_goal")
SCOPES = ("session", "tops", "document")
VISIBILITIES = ("private", "shared")


def read_templates(files: DataFrame) -> DataFrame:
    """files (value: a JSON list or {templates: [...]}) -> templates with their loose fields put right."""
    raw = "id string, label string, name string, scope string, description string, prompt_text string, text string, variables array<string>, scopes array<string>, is_active string, owner_id string, visibility string, revision string, created_at string, updated_at string"
    df = files.select(F.explode(jsonx.member_list(F.col("value"), "templates", raw)).alias("t")).select("t.*")
    df = df.withColumn("scopes", jsonx.scope_list(F.col("scopes"), F.col("scope"))).withColumn("label", F.coalesce("label", "name")).withColumn("prompt_text", F.coalesce("prompt_text", "text"))
    df = df.withColumn("is_active", jsonx.tolerant_bool(F.col("is_active"))).withColumn("revision", jsonx.tolerant_int(F.col("revision"))).withColumn("id", F.coalesce(text.filled(F.col("id")), text.prompt_id_slug(as_text(F.col("label")))))
    return schemas.conform(df, schemas.PROMPT)


def listed(templates: DataFrame, scope: str | None = None, only_active: bool = False) -> DataFrame:
    """Templates of a scope by their label without case."""
    df = templates.where(F.array_contains("scopes", scope)) if scope else templates
    return (df.where("is_active") if only_active else df).orderBy(F.lower("label"), "id")


def unknown_placeholders(template: Column) -> Column:
    return F.array_except(text.placeholders(template), F.array(*[F.lit(a) for a in ALLOWED]))


def problems() -> Column:
    """What is wrong with a template, as an array of text; empty if nothing is."""
    blank = lambda c: F.btrim(as_text(F.col(c))) == ""
    names = F.sort_array(unknown_placeholders(as_text(F.col("prompt_text"))))
    bad_scope = (F.size("scopes") == 0) | (F.size(F.array_except("scopes", F.array(*[F.lit(s) for s in SCOPES]))) > 0)
    # fixed values: the messages
    tests = [
        (blank("id"), F.lit("id is required")), (blank("label"), F.lit("label is required")), (F.coalesce(bad_scope, F.lit(True)), F.lit(f"scope must be one of {', '.join(sorted(SCOPES))}")),
        (blank("prompt_text"), F.lit("prompt_text is required")), (~F.coalesce(F.col("visibility"), F.lit("private")).isin(*VISIBILITIES), F.lit(f"visibility must be one of {', '.join(sorted(VISIBILITIES))}")),
        (F.col("revision") < 1, F.lit("revision must be >= 1")), (F.size(names) > 0, F.concat(F.lit("unknown placeholders: "), F.array_join(names, ", "))),
    ]
    return F.filter(F.array(*[F.when(t, m) for t, m in tests]), lambda x: x.isNotNull())


def save(templates: DataFrame, changed: DataFrame) -> DataFrame:
    """Templates with changed ones in their place, one revision higher than before and with the names they use;
    ValueError tells of the first template that has problems."""
    bad = changed.select("id", F.array_join(problems(), "; ").alias("p")).where("p <> ''").orderBy("id").first()
    if bad:
        raise ValueError(f"{bad.id}: {bad.p}")
    old = templates.select("id", F.col("revision").alias("__old"))
    new = changed.join(old, "id", "left").withColumn("revision", F.coalesce(F.col("__old") + 1, F.col("revision"), F.lit(1))).drop("__old")
    new = new.withColumn("variables", F.sort_array(text.placeholders(F.col("prompt_text"))))
    return templates.join(changed.select("id"), "id", "left_anti").unionByName(schemas.conform(new, schemas.PROMPT))


def deactivated(templates: DataFrame, template_id: str) -> DataFrame:
    """Templates with one switched off; nothing is deleted."""
    return templates.withColumn("is_active", F.col("is_active") & (F.col("id") != template_id))


def duplicated(templates: DataFrame, template_id: str, new_id: str) -> DataFrame:
    """Templates with a copy of one under a new id: revision 1, private, active, its label marked as a copy. A new id
    that is taken, or an unknown one to copy, raises ValueError."""
    found = {r["id"] for r in templates.where(F.col("id").isin(template_id, new_id)).select("id").collect()}
    if template_id not in found or new_id in found:
        raise ValueError(f"{template_id} can't be copied to {new_id}")
    copy = templates.where(F.col("id") == template_id)
    new = {"id": F.lit(new_id), "label": F.concat("label", F.lit(" (Kopie)")), "revision": F.lit(1), "visibility": F.lit("private"), "is_active": F.lit(True)}
    return templates.unionByName(copy.withColumns({k: v.cast(dict(templates.dtypes)[k]) for k, v in new.items()}))


def context(sessions: DataFrame, agenda: DataFrame, tops: tuple[str, ...] = (), goal: str = "") -> DataFrame:
    """session_id and the values of a template's names: the sources are the agenda items, of a choice those chosen."""
    items = agenda.where(F.col("number").isin(*tops)) if tops else agenda
    line = F.btrim(F.concat(F.lit("- "), as_text(F.col("number")), F.lit(" "), as_text(F.col("title"))))
    lists = items.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l")).select("session_id", F.array_join("l.line", "\n").alias("source_list"))
    df = sessions.join(lists, "session_id", "left")
    title = F.coalesce(text.filled(F.col("meeting_name")), text.filled(F.col("committee")), F.col("session_id"))
    return df.select("session_id", title.alias("session_title"), F.col("date").alias("session_date"), as_text(F.col("committee")).alias("committee"), F.lit(", ".join(tops)).alias("agenda_item"), F.lit("").alias("document_text"), as_text(F.col("source_list")).alias("source_list"), F.lit(goal).alias("analysis_goal"))


def load(spark: SparkSession, path: str, example: str | None = None) -> DataFrame:
    """The templates of a JSON file. A missing file is made first, as a copy of an example or without templates; a file
    that holds no list of templates raises ValueError."""
    for place in (path, example):
        where = spark._jvm.org.apache.hadoop.fs.Path(place) if place else None
        if where and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            break
    else:
        place = None
    body = spark.read.text(place, wholetext=True) if place else spark.createDataFrame([('{"templates": []}\n',)], "value string")
    value = "".join(r["value"] for r in body.collect())  # an empty file gives no row
    try:
        data = json.loads(value)
    except ValueError:
        data = None
    if not isinstance(data.get("templates") if isinstance(data, dict) else data, list):
        raise ValueError(f"no list of templates in {place or path}")
    if place != path:
        sinks.replace_text(spark, path, value)
    return read_templates(spark.createDataFrame([(value,)], "value string"))


def store(templates: DataFrame, path: str) -> None:
    """Write templates as one JSON file in place of the stored one. A store is written by people, so it is small."""
    rows = [json.loads(r[0]) for r in templates.orderBy("id").select(F.to_json(F.struct("*"))).toLocalIterator()]
    sinks.replace_text(templates.sparkSession, path, json.dumps({"templates": rows}, indent=2, ensure_ascii=False) + "\n")


def choice_error(requests: DataFrame, templates: DataFrame | None) -> DataFrame:
    """requests (request_id, template_id, scope) with error: none, unreadable (templates is None), missing, inactive,
    wrong_scope or null."""
    if templates is None:
        return requests.select("request_id", "template_id", "scope", F.when(as_text(F.col("template_id")) == "", "none").otherwise("unreadable").alias("error"))
    t = templates.select(F.col("id").alias("__id"), "scopes", "is_active")
    df = requests.join(t, F.col("template_id") == F.col("__id"), "left")
    error = F.when(as_text(F.col("template_id")) == "", "none").when(F.col("__id").isNull(), "missing").when(~F.col("is_active"), "inactive").when(~F.array_contains("scopes", F.col("scope")), "wrong_scope")
    return df.select("request_id", "template_id", "scope", error.alias("error"))
