"""Cleansing of model output: fenced JSON, irregular section lists, page labels.

JSON is read as VARIANT, so one malformed element never voids its array.  A null text
is absent; the element's own type decides, not the file's majority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

# The closed set of section types.
SECTION_TYPES = ("title", "section_title", "subtitle", "toc", "body", "figure", "caption", "footnote", "header", "page_number", "other")
NONE = "cast(array() AS array<struct<type:string,text:string>>)"


def json_object(x: str) -> str:
    """The object in a reply that may be fenced or surrounded by prose; NULL if there is none."""
    text = T.strip(x)
    bare = f"CASE WHEN {text} LIKE '```%' THEN regexp_replace(regexp_replace({text}, {T.raw(r'(?i)^```(?:json)?\s*')}, ''), {T.raw(r'\s*```$')}, '') ELSE {text} END"
    span = f"regexp_extract({bare}, {T.raw(r'(?s)(\{.*\})')}, 1)"
    found = f"coalesce(try_parse_json({bare}), try_parse_json({span}))"
    return f"CASE WHEN schema_of_variant({found}) LIKE 'OBJECT%' THEN {found} END"


def items(value: str, key: str) -> str:
    return f"coalesce(try_variant_get({value}, '$.{key}', 'array<variant>'), cast(array() AS array<variant>))"


def _is_object(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) LIKE 'OBJECT%', false)"


def _text(v: str, path: str) -> str:
    return T.strip(f"coalesce(try_variant_get({v}, '$.{path}', 'string'), '')")


def _type(v: str, known: bool) -> str:
    kind = f"coalesce(nullif(lower({_text(v, 'type')}), ''), 'body')"
    return f"CASE WHEN {kind} IN {SECTION_TYPES} THEN {kind} ELSE 'other' END" if known else kind


def _kept(array: str) -> str:
    return f"filter({array}, s -> s.text <> '')"


def loaded_sections(value: str) -> str:
    """Sections as a page loader takes them: objects only, unknown types kept, blank texts dropped."""
    return _kept(f"transform(filter({items(value, 'sections')}, v -> {_is_object('v')}), v -> named_struct('type', {_type('v', False)}, 'text', {_text('v', 'text')}))")


def sanitized_sections(value: str) -> str:
    """Sections; else the page's text as one body; else what ``blocks``, ``content`` and ``paragraphs`` hold together."""
    own = _kept(f"transform(filter({items(value, 'sections')}, v -> {_is_object('v')}), v -> named_struct('type', {_type('v', True)}, 'text', {_text('v', 'text')}))")
    whole = _text(value, "text")
    string = "coalesce(schema_of_variant(v) = 'STRING', false)"
    other_text = f"coalesce(nullif({_text('v', 'text')}, ''), {_text('v', 'content')})"
    spare = lambda key: _kept(f"""transform(filter({items(value, key)}, v -> {_is_object('v')} OR {string}), v ->
        CASE WHEN {string} THEN named_struct('type', 'body', 'text', {T.strip("coalesce(try_variant_get(v, '$', 'string'), '')")})
             ELSE named_struct('type', {_type('v', True)}, 'text', {other_text}) END)""")  # noqa: E731
    return f"""CASE WHEN size({own}) > 0 THEN {own} WHEN {whole} <> '' THEN array(named_struct('type', 'body', 'text', {whole}))
        ELSE concat({spare('blocks')}, {spare('content')}, {spare('paragraphs')}) END"""


def plain_text(sections: str) -> str:
    """Sections as text under bracketed type names."""
    return f"array_join(transform({sections}, s -> concat('[', upper(s.type), ']', chr(10), s.text)), concat(chr(10), chr(10)))"


def page_number(value: str, fallback: str) -> str:
    """A positive number or numeric string; floats are cut, so 0.5 gives 0; anything else gives the fallback."""
    kind = f"coalesce(schema_of_variant(variant_get({value}, '$.page', 'variant')), 'VOID')"
    whole = f"try_cast({_text(value, 'page')} AS int)"
    number = f"try_variant_get({value}, '$.page', 'double')"
    return f"""CASE WHEN {kind} IN ('VOID', 'BOOLEAN') THEN {fallback}
        WHEN {kind} = 'BIGINT' OR {kind} = 'STRING' THEN CASE WHEN {whole} > 0 THEN {whole} ELSE {fallback} END
        WHEN {kind} LIKE 'DECIMAL%' OR {kind} IN ('DOUBLE', 'FLOAT') THEN CASE WHEN {number} > 0 THEN cast({number} AS int) ELSE {fallback} END
        ELSE {fallback} END"""


def sanitize(replies: DataFrame) -> DataFrame:
    """(.., page, text, sections, ok) of rows (.., reply, page_num); ok is false where a reply holds no object."""
    value = replies.withColumn("value", F.expr(json_object("reply")))
    made = value.withColumn("sections", F.expr(f"CASE WHEN value IS NULL THEN {NONE} ELSE {sanitized_sections('value')} END"))
    own = _text("value", "text")
    return (made.withColumn("text", F.expr(f"CASE WHEN {own} <> '' THEN {own} ELSE {plain_text('sections')} END"))
            .withColumn("page", F.expr(page_number("value", "page_num"))).withColumn("ok", F.col("value").isNotNull()).drop("value", "reply"))


def with_empty_retry(replies: DataFrame, ask) -> DataFrame:
    """Replies without text and sections are asked for once more; ``ask`` is a DataFrame-to-DataFrame OCR adapter."""
    first = sanitize(replies)
    empty = (F.col("text") == "") & (F.size("sections") == 0)
    again = sanitize(ask(first.where(empty).drop("page", "text", "sections", "ok")))
    return first.where(~empty).unionByName(again)
