"""Schemas of the engine's tables, declared once."""

FRAME = "struct<hash:binary, timestamp:double>"
FILE_INFO = (
    "file_path string, content_hash binary, size bigint, created_at timestamp, modified_at timestamp, width int, height int, "
    "gps_latitude double, gps_longitude double, camera_model string, image_date timestamp, duration double, frames array<" + FRAME + ">"
)
CATALOG = (
    "file_path string, content_hash string, size bigint, created_at timestamp, modified_at timestamp, image_width int, image_height int, "
    "gps_latitude double, gps_longitude double, camera_model string, image_date timestamp, media_duration double, phash string, "
    "lsh_key1 string, lsh_key2 string, lsh_key3 string, lsh_key4 string"
)
#: The scoring inputs of a file.
SCORED = "size bigint, width int, height int, gps_latitude double, gps_longitude double, camera_model string, image_date timestamp, duration double"
CACHE = "job string, key string, config_hash string, value string"
