"""Logical schemas, enum codes and limits shared by every representation of a timeline."""

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))

RECORDS = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("partition", T.LongType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("headers", HEADERS),
    T.StructField("value", T.BinaryType()),
])

CODEC_NONE, CODEC_ZSTD = 0, 1
HASH_CRC32C, HASH_XXH64 = 0, 1
RECORD_FORMAT_V1 = 1

# Fixed values of the storage format.
MAX_RECORD_HEADERS = 64
MAX_HEADER_KEY_LEN = 1024
MAX_HEADER_VALUE_LEN = 65_535
MAX_HEADER_BYTES = 256 * 1024
MAX_VALUE_LEN = 4 * 1024 * 1024
MAX_RAW_BLOCK = 16 * 1024 * 1024
MAX_STORED_BLOCK = 20 * 1024 * 1024
MAX_RECORD_LSN = 2**64 - 2
EXHAUSTED_LSN = 2**64 - 1
MAX_ANALYTIC_LSN = 2**63 - 1

# Default policies.
READ_LIMIT = 1024
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 128, 1024
ROLL_RECORDS = 16_384
ROLL_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
DELETE_DELAY_MS = 24 * 3600 * 1000
