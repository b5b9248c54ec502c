"""What a file is, from its name, content type and first bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name endings by what they declare.
ACTIVE = (
    "exe com scr pif dll sys drv cpl ocx efi msi msp msix appx app gadget bat cmd ps1 psm1 psd1 vbs vbe js jse wsf wsh hta sh bash csh ksh zsh py pyc pyo "
    "pl php rb lua ahk scpt lnk url scf inf reg job appref-ms desktop service jar class iso img vhd vhdx vmdk dmg chm"
).split()
MACRO = "docm dotm xlsm xltm xlam pptm potm ppam ppsm".split()
ARCHIVES = "zip tar gz tgz bz2 tbz2 tb2 xz txz".split()
OPAQUE = "rar 7z arj ace lzh lha cab z alz uue".split()
ZIP_BASED = "docx docm dotx dotm xlsx xlsm xltx xltm pptx pptm potx potm ppsx odt ods odp".split()
EXECUTABLE = ("pe", "elf", "macho", "script", "class")
EXECUTABLE_TYPES = ("application/x-msdownload", "application/x-executable", "application/vnd.microsoft.portable-executable")
#: (kind, first bytes in hex). Fixed values.
MAGIC = (
    ("pdf", "25504446"), ("pe", "4D5A"), ("elf", "7F454C46"), ("macho", "FEEDFACE"), ("macho", "FEEDFACF"), ("macho", "CEFAEDFE"), ("macho", "CFFAEDFE"), ("class", "CAFEBABE"), ("script", "2321"),
    ("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("gz", "1F8B"), ("bz2", "425A68"), ("xz", "FD377A585A00"), ("rar", "52617221"), ("7z", "377ABCAF271C"), ("ole", "D0CF11E0A1B11AE1"), ("rtf", "7B5C727466"),
)
#: kinds that an ending may hold. Fixed values.
EXPECTED = {"pdf": ("pdf",), "p7m": ("ole",), "rtf": ("rtf",), "zip": ("zip",), "gz": ("gz",), "tgz": ("gz",), "bz2": ("bz2",), "xz": ("xz",), "rar": ("rar",), "7z": ("7z",), "doc": ("ole",), "xls": ("ole",), "ppt": ("ole",), "msg": ("ole",)}


def suffixes(name: Column) -> Column:
    """All endings of a file name from the first to the last, without those over 12 characters."""
    base = F.element_at(F.split(F.translate(F.trim(F.coalesce(name, F.lit(""))), "\\", "/"), "/"), -1)
    parts = F.slice(F.split(base, r"\."), F.lit(2), F.greatest(F.size(F.split(base, r"\.")) - 1, F.lit(0)))
    return F.transform(F.filter(parts, lambda p: (p != "") & (F.length(p) <= 12)), lambda p: F.lower(F.trim(p)))


def extension(name: Column) -> Column:
    """The last ending, empty where there is none."""
    s = suffixes(name)
    return F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(F.lit(""))


def last_extension(name: Column) -> Column:
    """What follows the last dot of the whole name, lower case, empty where there is none."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


#: methods that read pictures, statuses and endings of archives that stay closed. Fixed values.
OCR_METHODS = ("image_ocr", "pdf_ocr")
OPAQUE_STATUSES = ("unsupported_archive", "encrypted", "archive_limit")
ARCHIVE_ENDINGS = ("zip", "rar", "7z", "gz", "tgz", "bz2", "xz", "cab", "iso", "img", "arj", "lzh", "ace")


def attachment_flags(name: Column, method: Column, status: Column, chars: Column, archive: Column | None = None) -> Column:
    """STRUCT is_ocr, has_text, is_archive, extension, opaque, packed of an attachment row; nulls count as empty.

    ``opaque`` could not be opened, ``packed`` is any other archive.
    """
    ext = last_extension(F.coalesce(name, F.lit("")))
    opened = archive.isNotNull() if archive is not None else F.lit(False)
    state = F.coalesce(status, F.lit(""))
    return F.struct(
        F.coalesce(method, F.lit("")).isin(*OCR_METHODS).alias("is_ocr"), (F.coalesce(chars, F.lit(0)) > 0).alias("has_text"),
        (opened | (state == "unsupported_archive")).alias("is_archive"), ext.alias("extension"),
        state.isin(*OPAQUE_STATUSES).alias("opaque"), (~state.isin(*OPAQUE_STATUSES) & (opened | ext.isin(*ARCHIVE_ENDINGS))).alias("packed"),
    )


def active_name(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether any ending declares something that runs."""
    return F.arrays_overlap(suffixes(name), F.array(*[F.lit(x) for x in (*ACTIVE, *extra)]))


def sniff(data: Column) -> Column:
    """The kind that the first bytes show, empty where unknown or null; a PDF mark counts in the first 512 bytes."""
    head = F.hex(F.substring(data, 1, 512))
    kind = F.when(F.coalesce(F.length(data), F.lit(0)) == 0, F.lit(""))
    kind = kind.when(head.startswith("25504446") | head.rlike("^(?:..)*?255044462D"), F.lit("pdf"))
    for name, magic in MAGIC[1:]:
        kind = kind.when(head.startswith(magic), F.lit(name))
    return kind.otherwise(F.lit(""))


def archive_kind(name: Column, data: Column | None = None) -> Column:
    """zip, tar, gz, bz2, xz, opaque, or empty."""
    ext, seen = extension(name), sniff(data) if data is not None else F.lit("")
    tar = (F.hex(F.substring(data, 258, 5)) == "7573746172") if data is not None else F.lit(False)
    return (
        F.when(ext.isin(*OPAQUE) | seen.isin("rar", "7z"), "opaque").when((seen == "zip") | (ext == "zip"), "zip").when((ext == "tar") | F.coalesce(tar, F.lit(False)), "tar")
        .when((seen == "gz") | ext.isin("gz", "tgz"), "gz").when((seen == "bz2") | ext.isin("bz2", "tbz2", "tb2"), "bz2").when((seen == "xz") | ext.isin("xz", "txz"), "xz").otherwise("")
    )


def verdict(name: Column, content_type: Column, data: Column | None = None, extra: tuple[str, ...] = ()) -> Column:
    """STRUCT active, suspicious, macro_enabled, sniffed: content outranks the name."""
    ext = extension(name)
    seen = sniff(data) if data is not None else F.lit("")
    named = active_name(name, extra)
    runs = seen.isin(*EXECUTABLE)
    typed = F.coalesce(F.lower(content_type).isin(*EXECUTABLE_TYPES), F.lit(False))
    wrong = F.when(ext.isin(*ZIP_BASED), seen != "zip")
    for e, kinds in EXPECTED.items():
        wrong = wrong.when(ext == e, ~seen.isin(*kinds))
    mismatch = (ext != "") & (seen != "") & wrong.otherwise(F.lit(False))
    active = named | runs | typed
    return F.struct(
        active.alias("active"), F.when(named, F.lit(False)).when(runs, F.lit(True)).when(typed, F.lit(False)).otherwise(mismatch).alias("suspicious"),
        (~active & ext.isin(*MACRO)).alias("macro_enabled"), seen.alias("sniffed"),
    )
