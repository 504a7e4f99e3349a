"""Scalar functions as Columns: all of them stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> kind (fixed values); anything else is binary.
KINDS = {
    "pdf": "pdf",
    "document": "docx pptx xlsx ods",
    "image": "jpg jpeg png webp bmp tiff tif gif",
    "audio": "wav mp3 m4a aac flac ogg opus wma",
    "video": "mp4 mkv mov webm avi m4v",
    "code": "py js ts jsx tsx rs go java kt kts c h cpp hpp cs php rb swift dart sh ps1 bat cmd vue svelte",
    "text": "txt md markdown rst log ini cfg conf toml yaml yml json jsonl xml csv tsv sql html htm css scss less eml",
}
#: Order in which kinds are worked off; kinds that aren't named come last.
PRIORITIES = {"text": 0, "code": 1, "document": 2, "pdf": 2, "image": 3, "audio": 4}


def kind(extension: Column) -> Column:
    """Kind of a file by its extension, in any case; ``binary`` for none and unknown ones."""
    e = F.lower(extension)
    out = F.lit("binary")
    for name, extensions in KINDS.items():
        out = F.when(e.isin(*extensions.split()), name).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """Lower-case extension of a file name; null if it has none. A leading dot begins a name, no extension."""
    e = F.regexp_extract(name, r"[^.]\.([^.\\/]+)$", 1)
    return F.when(e != "", F.lower(e))


def priority(kind_: Column) -> Column:
    out = F.lit(5)
    for name, p in PRIORITIES.items():
        out = F.when(kind_ == name, p).otherwise(out)
    return out


def normal_path(path: Column) -> Column:
    """Trimmed, lower case, with ``/``, without verbatim prefixes and trailing slashes."""
    p = F.lower(F.translate(F.trim(path), "\\", "/"))
    p = F.regexp_replace(p, r"^//\?/unc/", "//")
    p = F.regexp_replace(p, r"^//\?/", "")
    return F.regexp_replace(p, r"/+$", "")


def display_path(path: Column) -> Column:
    r"""A path without ``\\?\`` and ``\\?\UNC\``."""
    p = F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\")
    return F.regexp_replace(p, r"^\\\\\?\\", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def depth(path: Column) -> Column:
    """Number of components of a path."""
    return F.size(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")).cast("long")


def ancestors(path: Column) -> Column:
    """Every prefix of a normal path that ends with a component, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def namespace(modality: Column) -> Column:
    return F.when(modality == "code", "code").otherwise("general")


def state(partial: Column, semantic: Column, chunks: Column) -> Column:
    """State of a file after its content was taken in: by error, vectors and number of chunks."""
    return F.when(partial.isNotNull(), "partial").when(semantic, "indexed").when(chunks == 0, "metadata_only").otherwise("partial")


def heading(line: Column, code: bool = False) -> Column:
    """A chunk's heading from its first line."""
    return F.substring(line, 1, 120) if code else F.substring(F.regexp_replace(line, r"^#+", ""), 1, 100)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def human_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB in steps of 1024, one decimal above bytes; null stays null."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .when(n.isNotNull(), F.format_string("%.1f GB", n / 1024**3))
    )


def clock(seconds: Column) -> Column:
    """hh:mm:ss of a number of seconds; null stays null."""
    s = F.floor(seconds).cast("long")
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def highlight(text: Column, words: list[str]) -> Column:
    """Words of two letters or digits and more between ``<mark>`` and ``</mark>``, in any case."""
    import re

    kept = sorted({w for w in words if sum(c.isalnum() for c in w) >= 2}, key=lambda w: (-len(w), w))
    if not kept:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in kept) + ")", "<mark>$1</mark>")


def excerpt(text: Column, length: int = 220) -> Column:
    return F.substring(text, 1, length)


def rrf(rank: Column, weight: float = 1.0) -> Column:
    """Reciprocal rank fusion; ranks count from 0."""
    return F.lit(weight) / (F.lit(60.0) + rank)


def _unaccented() -> tuple[str, str]:
    pairs = [(chr(o), unicodedata.normalize("NFD", chr(o))[0]) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for o in range(*r)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, *_unaccented()), r"[̀-ͯ]", "")


def words(text: Column, fold: bool = True) -> Column:
    """Lower-case runs of letters and digits; with ``fold`` also without accents. Null gives an empty array."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(strip_accents(t) if fold else t, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_count(text: Column, fold: bool = True) -> Column:
    """Size of :func:`words`, counted without making them."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(F.regexp_replace(t, r"[̀-ͯ]", "") if fold else t, F.lit(r"[\p{L}\p{N}]+"))


def usable_vector(vector: Column, dimensions: Column | int) -> Column:
    """As long as wanted, finite throughout, and not all zero."""
    n = dimensions if isinstance(dimensions, Column) else F.lit(dimensions)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == n) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_vector(vector: Column, dimensions: int) -> Column:
    """The first ``dimensions`` components at length 1; null where there are too few, or they aren't usable."""
    v = F.slice(vector.cast("array<double>"), 1, dimensions)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(usable_vector(v, dimensions), F.transform(v, lambda x: x / size))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def ewma(samples: Column, keep: float = 0.8) -> Column:
    """First sample, then ``keep`` of the old and the rest of the new; null for no samples."""
    return F.aggregate(samples, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * keep + x * (1 - keep)))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``5 s``, ``3 min`` or ``2 h 5 min``, rounded up to what is shown; null stays null."""
    s = F.ceil(seconds).cast("long")
    m = F.ceil(seconds / 60).cast("long")
    hours = F.format_string("%d h %d min", F.floor(m / 60), m % 60)
    return F.when(s < 60, F.format_string("%d s", s)).when(m < 60, F.format_string("%d min", m)).when(s.isNotNull(), hours)


def pack_vector(vector: Column) -> Column:
    """Components as little-endian 32-bit floats; null for a null vector."""

    @F.arrow_udf("binary")
    def pack(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())

    return pack(vector)


def unpack_vector(data: Column) -> Column:
    """The floats of :func:`pack_vector`; null for null and for bytes that are no whole number of floats."""

    @F.arrow_udf("array<float>")
    def unpack(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4") for x in v.to_pylist()], pa.list_(pa.float32()))

    return unpack(data)
