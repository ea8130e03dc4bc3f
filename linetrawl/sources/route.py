"""Which extractor a file goes to, decided on its name alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linetrawl.functions.paths import extension

# Extensions per route.
XLSX = (".xlsx", ".xlsm")
WORD = (".docx", ".doc")
SLIDES = (".pptx", ".ppt")
XLS = (".xls",)
OUT_OF_SCOPE = (".pdf", ".one")
OFFICE_ONLY = (".doc", ".docx", ".ppt", ".pptx", ".xls")
BINARY = tuple(
    """
    .exe .dll .so .dylib .bin .com .sys .o .obj .a .lib
    .zip .tar .gz .bz2 .7z .rar .xz .tgz .tbz2
    .png .jpg .jpeg .gif .bmp .webp .ico .tif .tiff .psd .heic .heif .raw
    .mp3 .mp4 .avi .mov .wav .flac .mkv .webm .wmv .m4a .m4v .aac .ogg .flv
    .ttf .otf .woff .woff2 .eot
    .pyc .pyo .class .jar .war
    .db .sqlite .sqlite3 .mdb .accdb
    .iso .dmg .vhd .vmdk
    """.split()
)


def route(path: Column, office: bool = False) -> Column:
    """``xlsx``, ``docx``, ``pptx``, ``text`` or ``skip``.

    Word and slide packages are read only with ``office``; the old binary formats never are.
    """
    ext = extension(path)
    packages = F.when(ext == ".docx", "docx").when(ext == ".pptx", "pptx") if office else F.when(F.lit(False), "")
    return F.coalesce(
        packages,
        F.when(ext.isin(*XLSX), "xlsx")
        .when(ext.isin(*OUT_OF_SCOPE, *WORD, *SLIDES, *XLS, *BINARY), "skip")
        .otherwise("text"),
    )


def skip_reason(path: Column, office: bool = False) -> Column:
    """Why a file is skipped without being read; NULL where it is not."""
    ext = extension(path)
    unread = [e for e in (*WORD, *SLIDES, *XLS) if not (office and e in (".docx", ".pptx"))]
    return (
        F.when(ext.isin(*OUT_OF_SCOPE), "scope_out")
        .when(ext.isin(*unread), "no_office")
        .when(ext.isin(*BINARY), "binary")
    )
