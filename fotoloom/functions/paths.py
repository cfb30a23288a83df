"""Path parts, file types and the extension allow-list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported extensions.
IMAGE_EXTENSIONS = (
    "jpg jpeg jpe jif jfif jfi jp2 j2c jpf jpx jpm mj2 png webp tif tiff bmp dib heic heif avif "
    "cr2 cr3 nef nrw arw srf sr2 dng orf ptx pef rw2 raf raw x3f srw"
).split()
VIDEO_EXTENSIONS = "mp4 m4v mov 3gp 3g2 avi mpg mpeg mpe mpv m2v m2p m2ts mts ts qt wmv asf flv f4v webm divx gif".split()

VIDEO, IMAGE = 0, 1


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))).otherwise(found)


def extension(path: Column) -> Column:
    """Without the dot, in the case given; a name that only begins with a dot has none."""
    return F.regexp_extract(path, "[^/][.]([^./]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    short = F.regexp_extract(name, "^(.+)[.][^.]*$", 1)
    return F.when(short == "", name).otherwise(short)


def file_type(path: Column) -> Column:
    """0 for video, 1 for image, null for what isn't supported."""
    ext = F.lower(extension(path))
    return F.when(ext.isin(IMAGE_EXTENSIONS), F.lit(IMAGE)).when(ext.isin(VIDEO_EXTENSIONS), F.lit(VIDEO))


def file_type_error(path: Column) -> Column:
    return F.when(file_type(path).isNull(), F.concat(F.lit("ValidationError: unsupported file type "), F.lower(extension(path))))


def normalize(path: Column) -> Column:
    """Separators as one '/', without '.' parts and a trailing separator."""
    one = F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), r"(^|/)(?:[.]/)+", "$1")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def _either_case(ext: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)


#: A glob for the reader's listing, so that other files are never opened.
ALL_PATTERN = "*.{" + ",".join(_either_case(e) for e in IMAGE_EXTENSIONS + VIDEO_EXTENSIONS) + "}"
