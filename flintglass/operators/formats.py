"""Formats of artifacts by extension and by first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintglass.functions import signatures as S


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The lower-case extension with its dot; empty for names without one, or whose only dot leads or ends them."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def by_extension(suffix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in S.FORMAT_OF.items() for x in pair])
    return F.try_element_at(table, suffix)


def by_magic(hexed: Column, suffix: Column) -> Column:
    """From the first bytes as upper-case hexadecimal; null if they tell nothing or there are fewer than two."""
    starts = lambda *magic: hexed.rlike(f"^({'|'.join(magic)})")
    return (
        F.when(F.length(hexed) < 4, F.lit(None).cast("string"))
        .when(starts("800[0-5]"), "pickle")
        .when(starts("504B0304", "504B0506"), "pytorch")
        .when(starts(S.ARCHIVE_MAGIC["7z"]), "7z_archive")
        .when(starts("47475546"), "gguf")
        .when(starts(S.HDF5_MAGIC), "keras")
        .when(starts("1F8B"), "gzip")
        .when(starts("934E554D5059"), "numpy")
        .when(starts("08") & (suffix == ".onnx"), "onnx")
    )


def detected(path: Column, hexed: Column) -> Column:
    """The extension decides; first bytes do for unknown extensions; else unknown."""
    suffix = suffix_of(path)
    return F.coalesce(by_extension(suffix), by_magic(hexed, suffix), F.lit("unknown"))


def media_kind(suffix: Column) -> Column:
    return F.when(suffix.isin(*S.IMAGE_EXTENSIONS), "image").when(suffix.isin(*S.VIDEO_EXTENSIONS), "video").otherwise("unknown")
