"""What of a message is shown to a reader that must not trust it: bounded excerpts inside a fence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import files, mime, text

#: How much of each part is shown, and what marks a text read from a picture.
SUBJECT, BODY, EACH, ATTACHMENTS, TOTAL = 400, 1500, 1200, 3, 4000
FENCE = "materiale_non_fidato"
OCR_MARK = " [TESTO DA OCR: cifre, date, importi e codici possono essere letti male]"


def inventory(attachments: Column) -> Column:
    """JSON array of a message's attachments: name, type, size, extraction and, only where they apply, its warnings."""

    def entry(a: Column) -> Column:
        flags = files.attachment_flags(a["name"], a["method"], a["status"], a["chars"])
        return F.struct(
            a["name"].alias("nome"), F.coalesce(F.when(a["content_type"] != "", a["content_type"]), F.lit("?")).alias("tipo"), F.coalesce(a["size"], F.lit(0)).alias("byte"), F.coalesce(F.when(a["status"] != "", a["status"]), F.lit("?")).alias("estrazione"),
            a["method"].alias("metodo"), F.coalesce(a["chars"], F.lit(0)).alias("caratteri_testo"), F.when(files.active_name(a["name"]), F.lit(True)).alias("contenuto_attivo"), F.when(flags["is_archive"], F.lit(True)).alias("archivio"),
        )

    return F.to_json(F.transform(attachments, entry), {"ignoreNullFields": "true"})


def candidates(attachments: Column) -> Column:
    """The attachments that may be shown: those with text, the largest first, at most three."""
    ranked = F.array_sort(F.transform(F.filter(attachments, lambda a: F.coalesce(a["chars"], F.lit(0)) > 0), lambda a: F.struct((-F.coalesce(a["size"], F.lit(0))).alias("rank"), a.alias("a"))))
    return F.transform(F.slice(ranked, 1, ATTACHMENTS), lambda r: r["a"])


def build(subject: Column, body: Column, attachments: Column, keywords: tuple[str, ...], nonce: Column) -> Column:
    """The fenced material of a message.

    Subject and body count towards the total, attachments get what is left; a forged fence tag or the
    nonce inside the text is replaced, so that the content cannot close its own fence. ``attachments``
    is an array of struct<name, method, size, chars, text>.
    """
    title = text.cut(text.normalize(subject), SUBJECT)
    shown = mime.excerpt(F.coalesce(text.normalize(body), F.lit("")), keywords, BODY)
    head = F.concat(F.lit("OGGETTO: "), F.when(title != "", title).otherwise("(nessun oggetto)"), F.lit("\n\n"), F.when(shown["text"] != "", F.concat(F.lit("CORPO:\n"), shown["text"])).otherwise("CORPO: (vuoto)"))
    used = F.length(title) + F.coalesce(shown["sent"], F.lit(0))
    start = F.struct(head.alias("out"), used.cast("int").alias("used"))

    def add(acc: Column, a: Column) -> Column:
        room = F.least(F.lit(EACH), F.lit(TOTAL) - acc["used"])
        part = F.substring(text.normalize(a["text"]), F.lit(1), F.greatest(room, F.lit(0)))
        mark = F.when(F.coalesce(a["method"], F.lit("")).isin(*files.OCR_METHODS), F.lit(OCR_MARK)).otherwise("")
        block = F.concat(F.lit("\n\nALLEGATO «"), F.coalesce(a["name"], F.lit("")), F.lit("»"), mark, F.lit(":\n"), part)
        keep = F.coalesce(F.length(part) > 0, F.lit(False))
        return F.struct(F.when(keep, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"), (acc["used"] + F.when(keep, F.length(part)).otherwise(0)).cast("int").alias("used"))

    whole = F.aggregate(candidates(attachments), start, add, lambda acc: acc["out"])
    clean = F.replace(text.neutralise_tags(whole), nonce, F.lit("[nonce rimosso]"))
    return F.concat(F.lit(f"<{FENCE} nonce=\""), nonce, F.lit('">\n'), clean, F.lit(f"\n</{FENCE} nonce=\""), nonce, F.lit('">'))
