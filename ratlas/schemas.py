"""The schemas of both indexes, defined once; columns that a table lacks are added as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SESSIONS = "session_id string, date string, year int, month int, committee string, meeting_name string, start_time string, location string, detail_url string, session_path string"
AGENDA_ITEMS = "id bigint, session_id string, number string, title string, reporter string, status string, decision string, documents_present int"
DOCUMENTS = "id bigint, session_id string, title string, category string, document_type string, agenda_item string, url string, local_path string, sha1 string, retrieved_at string, content_type string, content_length bigint"
ANALYSIS_JOBS = "id bigint, created_at string, session_id string, scope string, top_numbers_json string, purpose string, model_name string, prompt_version string, prompt_template_id string, prompt_template_revision int, prompt_template_label string, rendered_prompt_snapshot_path string, status string, error_message string"
ANALYSIS_OUTPUTS = "id bigint, job_id bigint, output_format string, content string, output_type string, schema_version string, json_path string, markdown_path string, status string, created_at string"
PUBLICATION_JOBS = "id bigint, job_id bigint, output_id bigint, status string, published_url string, created_at string"
VECTORS = "id decimal(20,0), dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>, payload struct<session_id:string,title:string,document_type:string,agenda_item:string,url:string,local_path:string,date:string,committee:string>"
MANIFEST = "session struct<id:string,committee:string,meeting_name:string,date:string,detail_url:string,location:string>, retrieved_at string, documents array<struct<title:string,category:string,agenda_item:string,url:string,path:string,sha1:string,content_type:string,content_disposition:string,content_length:bigint,etag:string,last_modified:string,retrieved_at:string>>"
AGENDA_SUMMARY = "session struct<id:string,committee:string,meeting_name:string,date:string>, generated_at string, agenda_items array<struct<number:string,title:string,reporter:string,status:string,decision:string,documents_present:boolean>>"
PROMPT = "id string, label string, scope string, description string, prompt_text string, variables array<string>, scopes array<string>, is_active boolean, owner_id string, visibility string, revision int, created_at string, updated_at string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order and types; missing ones are null, others are dropped."""
    fields = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
