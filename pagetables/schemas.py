"""Fixed schemas of the landed tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _time = T.StringType(), T.TimestampType()

REQUESTS = _schema(
    request_id=T.LongType(), ts=_time, method=_text, url=_text, user_agent=_text, accept=_text
)
HTTP_LOG = _schema(
    request_id=T.LongType(),
    ts=_time,
    method=_text,
    url=_text,
    original_url=_text,
    headers=T.MapType(_text, T.ArrayType(_text)),
)
RESPONSES = _schema(
    url=_text,
    http_status=T.IntegerType(),
    content_type=_text,
    html=_text,
    fetched_at=_time,
    fetch_error=_text,
)
SITEMAPS = _schema(sitemap_url=_text, http_status=T.IntegerType(), xml=_text, fetched_at=_time)
RESOURCES = _schema(
    key=_text, url=_text, status=_text, generated_at=_time, markdown=_text, reason=_text
)
STORED_JSON = _schema(key=_text, value=_text)
BOT_RULES = _schema(
    priority=T.IntegerType(), traffic=_text, name=_text, kind=_text, pattern=_text
)
CRAWL_MESSAGES = _schema(url=_text)
# The log behind the resource table, and the store of landed responses.  The facts of the
# Markdown are kept beside it, so that routing never reads it.
RESOURCE_LOG = T.StructType(
    [
        *RESOURCES,
        T.StructField("seq", T.LongType()),
        T.StructField("markdown_blank", T.BooleanType()),
        T.StructField("markdown_length", T.LongType()),
        T.StructField("written_at", _time),
        T.StructField("row", T.LongType()),
        T.StructField("place", _text),
    ]
)
RESPONSE_STORE = T.StructType(
    [*RESPONSES, T.StructField("key", _text), T.StructField("row", T.LongType()), T.StructField("place", _text)]
)
BATCHES = _schema(writer=_text, batch_id=T.LongType())
