"""The engine's functions by name, for SQL."""

from __future__ import annotations

import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.functions import content, display, names, rename, text
from quarry.sources.archive import is_noise, member_name

FUNCTIONS = {
    "name_fields": names.name_fields,
    "says_nothing": names.says_nothing,
    "stated_author": rename.stated_author,
    "decode_text": text.decoded,
    "decode_labelled": text.decoded_labelled,
    "unescape_html": text.unescape,
    "sentence_fingerprint": text.sentence_fingerprint,
    "sentence_array": text.sentence_array,
    "epub_metadata": content.epub_metadata,
    "epub_body": content.epub_body,
    "book_cover": content.cover,
    "recovered_title": content.recovered_title,
    "archive_health": content.archive_health,
    "image_dimensions": content.image_dimensions,
    "member_category": content.member_category,
    "diff_ranges": display.diff_ranges,
}


@udtf(returnType="member string, entry int, size long, compressed long, crc32 string, error string")
class ArchiveMembers:
    """archive_members(path): the members of an archive from its directory; a broken one gives a row with the error."""

    def eval(self, path: str):
        try:
            with zipfile.ZipFile(path) as archive:
                for k, info in enumerate(archive.infolist()):
                    if not info.is_dir() and not is_noise(info.filename):
                        yield member_name(info), k, info.file_size, info.compress_size, f"{info.CRC:08x}", None
        except Exception as e:  # noqa: BLE001  a broken archive is a row
            yield None, None, None, None, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable from SQL; their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("archive_members", ArchiveMembers)
    return [*FUNCTIONS, "archive_members"]
