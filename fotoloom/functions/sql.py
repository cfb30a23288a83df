"""The scalar functions as SQL functions of a session, for queries written as text.

They are SQL bodies, inlined by the optimizer; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


FUNCTIONS = {
    "hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "image_similarity(a BIGINT, b BIGINT) RETURNS DOUBLE": "coalesce(1 - bit_count(a ^ b) / 64D, 0D)",
    "phash_bits(phash STRING) RETURNS BIGINT": "CAST(conv(phash, 16, -10) AS BIGINT)",
    "lsh_keys(phash STRING) RETURNS ARRAY<STRING>": "CASE WHEN length(phash) = 16 THEN transform(array(1, 5, 9, 13), i -> substring(phash, i, 4)) END",
    "file_extension(path STRING) RETURNS STRING": r"regexp_extract(path, '[^/][.]([^./]*)$', 1)",
    "file_stem(path STRING) RETURNS STRING": r"coalesce(nullif(regexp_extract(path, '([^/]+)[.][^./]*$', 1), ''), regexp_extract(path, '([^/]*)$', 1))",
    "media_type(path STRING) RETURNS INT": (
        rf"CASE WHEN lower(regexp_extract(path, '[^/][.]([^./]*)$', 1)) IN ({_list(IMAGE_EXTENSIONS)}) THEN 1 WHEN lower(regexp_extract(path, '[^/][.]([^./]*)$', 1)) IN ({_list(VIDEO_EXTENSIONS)}) THEN 0 END"
    ),
    "exif_date(tag STRING) RETURNS TIMESTAMP": r"try_cast(regexp_replace(tag, r'^(.*?)(\d{4}):(\d{2}):(\d{2})', '$1$2-$3-$4') AS TIMESTAMP)",
    "kth_smallest(a ARRAY<DOUBLE>, k INT) RETURNS DOUBLE": "get(sort_array(a), k)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
