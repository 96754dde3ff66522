"""Folders of media files as a table: listing, times, sizes, hashes, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Types by file extension, five classes of media.
TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "avif": "image/avif",
    "mp4": "video/mp4", "m4v": "video/x-m4v", "mkv": "video/x-matroska", "webm": "video/webm", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "mp3": "audio/mpeg", "flac": "audio/flac", "wav": "audio/wav", "ogg": "audio/ogg", "opus": "audio/opus", "m4a": "audio/mp4",
    "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "epub": "application/epub+zip",
}
#: Folders that hold no library files.
JUNK = ("$RECYCLE.BIN", "System Volume Information", "__MACOSX", ".git", "node_modules", ".Trash")


def extension(path: Column) -> Column:
    """The lower-case extension of a path, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def mime_type(path: Column) -> Column:
    """Type by extension, null where it is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), extension(path))


def sniffed(content: Column) -> Column:
    """What a file that could not be read turns out to be by its first bytes: apple-double, html or null."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 256), "ISO-8859-1")))
    return F.when(head.isin("00051607", "00051600"), "apple-double").when(text.startswith("<!doctype html") | text.startswith("<html"), "html")


def listing(spark: SparkSession, folder: str, hashes: bool = True) -> DataFrame:
    """(path, last_modified, file_size, type[, md5, sha256]) of media files under a folder.

    Hidden and temporary files, junk folders and unknown extensions are left
    out. Contents are read only if hashes are wanted.
    """
    glob = "*.{" + ",".join(sorted({*TYPES, *(e.upper() for e in TYPES)})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    hidden = name.startswith(".") | name.startswith("~") | F.lower(name).rlike(r"\.(tmp|part|crdownload)$") | F.arrays_overlap(parts, F.array(*map(F.lit, JUNK)))
    base = files.where(~hidden)
    columns = [path.alias("path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"), F.col("length").alias("file_size"), mime_type(F.col("path")).alias("type")]
    return base.select(*columns, *([F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")] if hashes else []))
