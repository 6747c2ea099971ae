"""Fingerprints, dumps, entropy and format dispatch over a binary column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES, ENTROPY_BYTES, DUMP_BYTES = 10 * 1024 * 1024, 65_536, 32

# Extensions and brands that decide a format.
MP4_EXTENSIONS = ("mp4", "m4a", "mov", "m4v", "3gp", "3g2")
MP4_BOXES = ("ftyp", "moov", "mdat", "free", "skip")
STILL_BRANDS = ("heic", "heix", "hevc", "heim", "heis", "mif1", "msf1", "avif", "avis")
STILL_EXTENSIONS = ("heic", "heif", "avif")
DOCUMENT_FORMATS = ("pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "zip")


def fingerprint(content: Column) -> list[Column]:
    """sha256 of all bytes, of the first 10 MiB, and the number of bytes."""
    return [
        F.sha2(content, 256).alias("sha256"),
        F.sha2(F.substring(content, 1, HEAD_BYTES), 256).alias("sha256_head10m"),
        F.octet_length(content).cast("bigint").alias("n_bytes"),
    ]


def head_hex(content: Column, n: int = DUMP_BYTES) -> Column:
    """Upper-case hex of the first n bytes: one space between bytes, two after each eighth."""
    pairs = F.regexp_replace(F.hex(F.substring(content, 1, n)), "(..)", "$1 ")
    return F.trim(F.regexp_replace(pairs, "((?:.. ){8})", "$1 "))


def head_ascii(content: Column, n: int = DUMP_BYTES) -> Column:
    return F.regexp_replace(F.decode(F.substring(content, 1, n), "ISO-8859-1"), "[^ -~]", ".")


def _starts(content: Column, hexa: str, at: int = 0) -> Column:
    return F.hex(F.substring(content, at + 1, len(hexa) // 2)) == hexa


def _ascii_at(content: Column, at: int, n: int = 4) -> Column:
    return F.decode(F.substring(content, at + 1, n), "ISO-8859-1")


def mime_magic(content: Column) -> Column:
    """MIME type by leading bytes, first match wins; any RIFF is audio/wav and any ftyp video/mp4."""
    return (
        F.when(_starts(content, "FFD8"), "image/jpeg").when(_starts(content, "89504E"), "image/png").when(_ascii_at(content, 0) == "RIFF", "audio/wav")
        .when(_ascii_at(content, 4) == "ftyp", "video/mp4").when(_starts(content, "494433"), "audio/mpeg").when(_starts(content, "25504446"), "application/pdf")
        .when(_starts(content, "1A45DFA3"), "video/webm").otherwise("application/octet-stream")
    )


def format_of(content: Column, extension: Column) -> Column:
    """The parser that reads the file: first match wins, an extension alone is enough for most."""
    e, four = F.lower(extension), _ascii_at(content, 0)
    zip_ = _starts(content, "504B03") | _starts(content, "504B05")
    still = ((_ascii_at(content, 4) == "ftyp") & (F.octet_length(content) > 12) & _ascii_at(content, 8).isin(*STILL_BRANDS)) | e.isin(*STILL_EXTENSIONS)
    mp4 = e.isin(*MP4_EXTENSIONS) | _ascii_at(content, 4).isin(*MP4_BOXES)
    sync = _starts(content, "FF") & (F.hex(F.substring(content, 2, 1)) >= "E0")
    return (
        F.when(zip_, "zip").when(still, "heif").when(mp4, "mp4")
        .when((four == "RIFF") & (_ascii_at(content, 8) == "WAVE"), "wav")
        .when((e == "mp3") | _starts(content, "494433") | sync, "mp3")
        .when((e == "flac") | (four == "fLaC"), "flac")
        .when(e.isin("ogg", "opus") | (four == "OggS"), "ogg")
        .when(e.isin("webm", "mkv") | _starts(content, "1A45DFA3"), "webm")
        .when(e.isin("jpg", "jpeg") | _starts(content, "FFD8"), "jpeg")
        .when((e == "png") | _starts(content, "89504E47"), "png")
        .when((e == "webp") | ((four == "RIFF") & (_ascii_at(content, 8) == "WEBP")), "webp")
        .when((e == "gif") | _starts(content, "474946"), "gif")
        .when((e == "pdf") | _starts(content, "25504446"), "pdf")
        .when(_starts(content, "49492A00") | _starts(content, "4D4D002A"), "tiff")
        .otherwise("generic")
    )


def byte_entropy(content: Column, n: int = ENTROPY_BYTES) -> Column:
    """Shannon entropy in bits a byte of the first n bytes; 0 for an empty value."""

    @F.pandas_udf("double")
    def entropy(values: pd.Series) -> pd.Series:
        def one(x) -> float:
            counts = np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256)
            p = counts[counts > 0] / max(1, counts.sum())
            return float(-(p * np.log2(p)).sum()) if len(p) else 0.0

        return values.map(one, na_action=None)

    return entropy(F.substring(content, 1, n))


def byte_histogram(df: DataFrame, key: str, content: Column, n: int = ENTROPY_BYTES) -> DataFrame:
    """key, byte, n: how often each byte occurs among the first n of each row; a row gives at most 256 rows."""

    @F.pandas_udf("array<struct<byte:string,n:bigint>>")
    def counts(values: pd.Series) -> pd.Series:
        def one(x) -> list[dict]:
            found = np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256)
            return [{"byte": f"{b:02X}", "n": int(found[b])} for b in np.flatnonzero(found)]

        return values.map(one, na_action=None)

    each = df.select(key, F.explode(counts(F.substring(content, 1, n))).alias("c")).select(key, "c.*")
    return each.groupBy(key, "byte").agg(F.sum("n").alias("n"))
