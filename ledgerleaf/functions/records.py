"""Questions, responses and document metadata as JSON text and back; times are ISO 8601."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION = (
    "question_id string, query_text string, expected_answer string, question_type string, difficulty int, requires_table boolean, requires_multi_doc boolean, "
    "source_documents array<string>, key_values array<string>"
)
RESPONSE = "query string, answer string, entropy double, abstained boolean, confidence string, n_sources int, sources array<struct<rank:int,id:string,content:string,distance:double>>, created string"
METADATA = "doc_id string, doc_type string, title string, doc_date string, file_path string, meeting_date string, pages int, download_date string, url string"
DOCUMENT_TYPES = ("statement", "minutes", "presconf", "sep", "implementation")
CHUNK_TYPES = ("text", "table", "figure", "multimodal")
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso(time: Column) -> Column:
    """A time as ISO text, with a fraction where it has one; null for null."""
    text = F.date_format(time, _ISO)
    micros = F.date_format(time, "SSSSSS")
    return F.when(micros == "000000", text).otherwise(F.concat(text, F.lit("."), micros))


def from_iso(text: Column) -> Column:
    """A timestamp without zone from ISO text, dates included; null for what is none."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def document_type(value: Column) -> Column:
    """The type without case and padding; null for what is none of the known ones."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(*DOCUMENT_TYPES), plain)


def to_records(rows: DataFrame, schema: str) -> DataFrame:
    """``record``: each row's columns of the schema as JSON text; nulls are left out, timestamps become ISO text."""
    kinds = dict(rows.dtypes)
    fields = [f.split(" ", 1)[0] for f in _fields(schema)]
    columns = [(iso(F.col(c)) if kinds[c].startswith(("timestamp", "date")) else F.col(c)).alias(c) for c in fields if c in kinds]
    return rows.select(F.to_json(F.struct(*columns)).alias("record"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """The columns of ``record``; text that does not parse gives nulls."""
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def _fields(schema: str) -> list[str]:
    """The schema's fields; commas within angle brackets part none."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
