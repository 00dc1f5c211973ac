"""The medium of a content, from its first bytes, its text and its file name."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.documents import decoded

#: First bytes (in hexadecimal) and their medium; brands of an ftyp box; kinds of a RIFF container.
MAGIC = {
    "FFD8FF": "image", "89504E470D0A1A0A": "image", "474946383761": "image", "474946383961": "image", "424D": "image", "49492A00": "image", "4D4D002A": "image",
    "1A45DFA3": "video", "494433": "audio", "FFFB": "audio", "FFFA": "audio", "FFF3": "audio", "FFF2": "audio", "664C6143": "audio", "4F676753": "audio",
}
RIFF = {"WEBP": "image", "WAVE": "audio", "AVI ": "video"}
IMAGE_BRANDS, AUDIO_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "crx ", "cr3 "), ("M4A ", "M4B ")
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif", "svg", "ico", "raw", "arw", "cr2", "cr3", "nef", "nrw", "orf", "rw2", "pef", "srw", "x3f", "raf", "dng", "dcr", "kdc", "mrw", "3fr", "mef", "mos", "erf", "rwl"),
    "video": ("mp4", "mov", "avi", "webm", "mkv", "m4v", "wmv", "flv"),
    "audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac", "wma"),
    "text": ("txt", "md", "rst", "csv", "tsv", "log", "xml", "html", "htm"),
    "json": ("json", "jsonl", "geojson"),
}
AFFORDANCES = {
    "image": ["can_caption", "can_detect_objects", "can_embed_image", "can_extract_exif"],
    "video": ["can_extract_audio", "can_sample_frames", "can_segment"],
    "text": ["can_chunk", "can_embed_text", "can_parse_text"],
    "json": ["can_embed_text", "can_infer_schema", "can_parse_keys"],
    "audio": ["can_embed_audio", "can_transcribe"],
    "binary": ["can_entropy_analyze", "can_magic_sniff"],
}
#: Fixed value: bytes that a probe of a path reads.
HEADER_BYTES = 32
#: Characters that can't be printed: control, format and unassigned ones, and separators other than a space, a tab and line ends.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \t\r\n]]"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cases(value: Column, table: dict[str, str]) -> Column:
    return reduce(lambda rest, x: F.when(value == x[0], F.lit(x[1])).otherwise(rest), table.items(), F.lit(None).cast("string"))


def medium_by_magic(content: Column | str) -> Column:
    """NULL if the first bytes say nothing."""
    c = _column(content)
    head = F.hex(F.substring(c, 1, 16))
    word = lambda at: F.decode(F.substring(c, at, 4), "ISO-8859-1")
    long = F.length(c) >= 12
    box = F.when(long & (word(5) == "ftyp"), word(9)).when(long & (word(1) == "ftyp"), word(5))
    brand = F.when(box.isin(*IMAGE_BRANDS), "image").when(box.isin(*AUDIO_BRANDS), "audio").when(box.isNotNull(), "video")
    magic = reduce(lambda rest, x: F.when(head.startswith(x[0]), F.lit(x[1])).otherwise(rest), MAGIC.items(), F.lit(None).cast("string"))
    return F.coalesce(F.when(long & (word(1) == "RIFF"), _cases(word(9), RIFF)), brand, magic)


@F.pandas_udf(T.BooleanType())
def _is_json(texts: pd.Series) -> pd.Series:
    """Whether Python's parser takes a text; NULL for NULL."""

    def valid(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            json.loads(text.strip())
            return True
        except ValueError:
            return False

    return texts.map(valid).astype("boolean")


def readable(text: Column) -> Column:
    """Whether over nine tenths of the first 1,000 characters can be printed."""
    head = F.substring(text, 1, 1000)
    return F.length(head) - F.regexp_count(head, F.lit(_UNPRINTABLE)) > 0.9 * F.length(head)


def medium_by_text(content: Column | str, unless: Column | None = None) -> Column:
    """json, text or NULL.  Python parses only what may be JSON by its first character, and nothing where ``unless`` holds."""
    c = _column(content)
    text, plain = decoded(c), F.is_valid_utf8(c.cast("string"))
    legible = readable(text)
    begins = text.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*[\[{]") & (plain | legible)
    begins = begins if unless is None else begins & ~F.coalesce(unless, F.lit(False))
    return F.when(F.coalesce(_is_json(F.when(begins, text)), F.lit(False)), "json").when(legible, "text")


def medium_by_extension(path: Column | str) -> Column:
    name = F.substring_index(_column(path), "/", -1)
    suffix = F.lower(F.when(name.rlike(r"^.+\.[^.]+$"), F.substring_index(name, ".", -1)))
    return _cases(suffix, {e: medium for medium, all_ in EXTENSIONS.items() for e in all_})


def probe_medium(content: Column | str, path: Column | str) -> Column:
    """First bytes, then text, then file name; empty contents and the rest are binary."""
    c = _column(content)
    magic = medium_by_magic(c)
    return F.when(c.isNull() | (F.length(c) == 0), "binary").otherwise(F.coalesce(magic, medium_by_text(c, magic.isNotNull()), medium_by_extension(path), F.lit("binary")))


def probe_header(content: Column | str, path: Column | str) -> Column:
    """The same from the first bytes only, as long contents on disk are probed."""
    return probe_medium(F.substring(_column(content), 1, HEADER_BYTES), path)


def affordances(medium: Column | str) -> Column:
    m = _column(medium)
    return reduce(lambda rest, x: F.when(m == x[0], F.array(*map(F.lit, x[1]))).otherwise(rest), AFFORDANCES.items(), F.array().cast("array<string>"))


#: EXIF keys of equipment and the identifier types they give.
EXIF_IDS = {"bodyserialnumber": "camera_serial_number", "lensserialnumber": "lens_serial_number", "imageuniqueid": "image_unique_id"}


def exif_ids(tags: Column | str) -> Column:
    """Identifiers held in a map of lower-case EXIF tags; '' and '0' are none."""
    tags = _column(tags)
    each = [F.struct(F.lit(kind).alias("id_type"), F.trim(tags[tag]).alias("id_value"), F.lit("source:exif").alias("id_namespace")) for tag, kind in EXIF_IDS.items()]
    return F.filter(F.array(*each), lambda x: x["id_value"].isNotNull() & ~x["id_value"].isin("", "0"))
