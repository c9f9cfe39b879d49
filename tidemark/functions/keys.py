"""Object-key layout and stream identity as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequestError

SEGMENT_NAME = r"seg-([0-9]{20})-e([0-9]{20})-([0-9a-f]{32})\.plseg$"


def canonical_stream_id(name: str) -> str:
    """Strip outer slashes and reject names that cannot be part of a key."""
    name = name.strip("/")
    try:
        size = len(name.encode())
    except UnicodeEncodeError:
        raise InvalidRequestError("stream id is not valid UTF-8") from None
    if not name or size > 512:
        raise InvalidRequestError("stream id must have 1 to 512 bytes")
    if any(part in ("", ".", "..") for part in name.split("/")):
        raise InvalidRequestError("stream id has an empty or relative path part")
    if any(unicodedata.category(c) == "Cc" for c in name):
        raise InvalidRequestError("stream id has a control character")
    return name


def normalized(stream: Column) -> Column:
    return F.regexp_replace(stream, "^/+|/+$", "")


def stream_key(stream: Column) -> Column:
    return F.sha2(normalized(stream).cast("binary"), 256)


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def segment_name(base_lsn: Column, epoch: Column, uuid: Column) -> Column:
    return F.concat(F.lit("seg-"), padded(base_lsn), F.lit("-e"), padded(epoch), F.lit("-"), uuid, F.lit(".plseg"))


def parsed_segment(key: Column) -> dict[str, Column]:
    """Columns base_lsn, writer_epoch and uuid of a segment key; null where it is malformed."""
    part = lambda i: F.nullif(F.regexp_extract(key, SEGMENT_NAME, i), F.lit(""))
    return {"base_lsn": part(1).cast("decimal(20,0)"), "writer_epoch": part(2).cast("decimal(20,0)"), "uuid": part(3)}
