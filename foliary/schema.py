"""Schemas of the archive's relations, the export contract and what is generated from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the archive's relations and of a manifest, their types and order.
_RECORD_DDL = """
id bigint, page bigint, title string, court string, judge string, date_delivered string, date_uploaded string, view_url string, pdf_url string,
collection_uuid string, document_uuid string, neutral_citation string, record_number string, status_field string, result string, composition string,
meta_json string, filename string, sha256 string, bytes bigint, meta_status string, download_status string, error_reason string, listed_at string,
meta_retrieved_at string, pdf_retrieved_at string, http_last_modified string, http_etag string, http_content_length bigint, http_content_type string,
last_revalidated_at string
"""
_VERSION_DDL = """
id bigint, record_id bigint, document_uuid string, pdf_url string, neutral_citation string, filename string, sha256 string, bytes bigint,
fetched_at string, superseded_at string, http_last_modified string, http_etag string, http_content_length bigint, http_content_type string
"""


def _struct(ddl: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.replace("\n", " ").split(","))])


RECORD, VERSION = _struct(_RECORD_DDL), _struct(_VERSION_DDL)
META_JSON = "neutral_citation string, fields map<string,string>, supplementary array<struct<label:string,url:string>>"
MANIFEST = (
    "tool string, version string, created string, base_url string, query string, courts array<string>, delay double, jitter double, user_agent string, "
    "listing struct<complete:boolean,truncated:boolean,max_pages:bigint,pages_fetched:bigint,pages_available:bigint>"
)
DERIVE_VERSION = 1
SCHEMA_VERSION = 1
VERSION_OF_TOOL = "0.2.0"

# The label vocabularies.
STATUS_VOCABULARY = ["Approved", "Unapproved"]
RESULT_VOCABULARY = ["Allow", "Allow Appeal", "Appeal allowed", "Appeal dismissed", "Dismiss", "Dismiss Appeal", "Dismissed", "Other", "Refuse", "Referral to the Court of Justice of the EU"]


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    about: str
    format: str | None = None

    @property
    def title(self) -> str:
        return self.name.replace("_", " ").capitalize()


# Names, types and order of the published columns.
EXPORT_FIELDS = [
    Field("document_uuid", "string", "Identifies the document; primary key."),
    Field("collection_uuid", "string", "Groups the documents of one case."),
    Field("neutral_citation", "string", "Citation of the case; its documents share it, so it is no key."),
    Field("title", "string", "Title of the case."),
    Field("court", "string", "Name of the court."),
    Field("authoring_judge", "string", "Who wrote this document."),
    Field("panel", "string", "All who heard the case, joined by '; '."),
    Field("panel_count", "integer", "How many heard the case."),
    Field("date_delivered", "date", "Day of delivery.", "%Y-%m-%d"),
    Field("date_uploaded", "date", "Day of publication.", "%Y-%m-%d"),
    Field("record_number", "string", "Number in the court's records."),
    Field("status", "string", "Status as served."),
    Field("status_in_vocab", "boolean", "Whether the status is in the list of known ones, or missing."),
    Field("result", "string", "Result as served."),
    Field("result_in_vocab", "boolean", "Whether the result is in the list of known ones, or missing."),
    Field("vocab_flags", "string", "What is not in a vocabulary, in words."),
    Field("view_url", "string", "Page about the document.", "uri"),
    Field("pdf_url", "string", "The document's own address.", "uri"),
    Field("filename", "string", "Name of the file."),
    Field("sha256", "string", "Digest of the file."),
    Field("bytes", "integer", "Size of the file."),
    Field("http_content_type", "string", "Content-Type as served."),
    Field("http_content_length", "integer", "Content-Length as served."),
    Field("http_last_modified", "string", "Last-Modified as served."),
    Field("http_etag", "string", "ETag as served."),
    Field("listed_at", "datetime", "Time of the first listing that showed it, UTC."),
    Field("meta_retrieved_at", "datetime", "Time of the page visit that gave the details, UTC."),
    Field("pdf_retrieved_at", "datetime", "Time at which the stored file came in, UTC."),
    Field("meta_status", "string", "pending, ok or error."),
    Field("download_status", "string", "pending, done or error."),
]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; what an older table lacks is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def table_schema() -> dict:
    fields = [{"name": f.name, "type": f.type, "title": f.title, "description": f.about} | ({"format": f.format} if f.format else {}) for f in EXPORT_FIELDS]
    return {"fields": fields, "primaryKey": "document_uuid", "missingValues": [""]}


def dictionary() -> str:
    """The published columns as a Markdown table."""
    rows = [f"| `{f.name}` | {f.type} | {f.format or ''} | {f.about.replace('|', chr(92) + '|')} |" for f in EXPORT_FIELDS]
    return "\n".join(["# Columns", "", "Primary key: `document_uuid`. Missing values are empty.", "", "| Column | Type | Format | About |", "|-|-|-|-|", *rows, ""])
