"""Text functions as Column expressions: they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, in step.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Word lists of the lexical scan. U: word signs and boundaries as Unicode has them.
REMINDER = r"(?iU)\b(sollecit\w+|insolut\w+|diffid\w+|intimazion\w+|morosit\w+|mancato pagamento|pagamento non pervenuto|ultimo avviso)\b"
URGENCY = r"(?iU)\b(urgent\w+|immediat\w+|entro (?:24|48) ore|improrogabil\w+|tassativ\w+|pena la sospensione)\b"
PAYMENT = r"(?iU)\b(iban|bonific\w+|coordinate bancarie|nuove coordinate|conto corrente|swift|bic)\b"
#: (name, pattern) of phrases that speak to a model instead of the addressee. Fixed values.
INJECTIONS = (
    ("ignora_istruzioni", r"(?iUm)\bignor\w+\s+(?:le\s+)?(?:precedenti\s+)?istruzion"),
    ("ignore_previous", r"(?iUm)\bignore\s+(?:all\s+|the\s+)?(?:previous|prior|above)\b"),
    ("disregard", r"(?iUm)\bdisregard\s+(?:all\s+|the\s+)?(?:previous|prior|above)\b"),
    ("ruolo_imposto", r"(?iUm)\b(?:sei|agisci come)\s+un(?:'|\s+)?(?:assistente|intelligenza artificiale|modello linguistico)"),
    ("ruolo_imposto", r"(?iUm)\byou\s+are\s+(?:an?\s+)?(?:ai\s+)?(?:assistant|language model)\b"),
    ("system_prompt", r"(?iUm)\b(?:system|developer)\s+prompt\b"),
    ("tag_falsificato", r"(?iUm)</?\s*(?:materiale_non_fidato|system|istruzioni)\b"),
    ("marcatore_di_turno", r"(?iUm)^\s*(?:human|assistant|system)\s*:"),
    ("istruzione_di_inoltro", r"(?iUm)^\s*(?:inoltra(?:re|lo|la)?|gira(?:re)?|spedisci|forward)\s+(?:quest[oa]|il|la|lo)?\s*(?:messaggio|documento|mail|email|allegato|pec)?\s*a\s+\S+@"),
    ("richiesta_di_silenzio", r"(?iUm)\bnon\s+(?:mostrare|segnalare|riportare)\s+(?:questo|nulla)"),
)
#: (pattern, replacement) of secrets in log lines. Fixed values.
SECRETS = (
    (r"(?iU)\b(password|passwd|pwd|token|secret|api[-_ ]?key|x-api-key)\b\s*[:=]\s*\S+", "$1=***"),
    (r"(?iU)\b(LOGIN|AUTHENTICATE)\s+(\S+)\s+(\S+)", "$1 $2 ***"),
    (r"sk-ant-[A-Za-z0-9_\-]{8,}", "sk-ant-***"),
)


def fold(c: Column) -> Column:
    """Lower case without accents, as words are compared in the search index."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Distinct search words of a text, empty for a null one."""
    return F.coalesce(F.array_distinct(F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}]+"), "")), F.array().cast("array<string>"))


def normalize(c: Column) -> Column:
    """Line ends to LF, control characters to blanks, runs of blanks closed up, at most one empty line."""
    s = F.regexp_replace(c, "\r\n?", "\n")
    s = F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F]", " ")
    s = F.regexp_replace(s, "[ \t ]+", " ")
    s = F.regexp_replace(s, " *\n", "\n")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(s, r"^[ \n]+", ""), r"[ \n]+$", "")


def redact_secrets(c: Column) -> Column:
    """Values of passwords, logins and API keys become ***."""
    for pattern, safe in SECRETS:
        c = F.regexp_replace(c, pattern, safe)
    return c


def injection_hits(c: Column) -> Column:
    """Names of the patterns that a text hits, each once, in their fixed order; empty for a null text."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in INJECTIONS])))


def neutralise_tags(c: Column) -> Column:
    """Forged fence tags are replaced by a notice."""
    return F.regexp_replace(c, r"(?i)</?\s*materiale_non_fidato[^>]*>", "[tag rimosso]")


def escape_html(c: Column) -> Column:
    """The five signs that HTML reserves, as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def domain(c: Column) -> Column:
    """What follows the last @, empty where there is none, null for null."""
    return F.when(F.instr(c, "@") > 0, F.lower(F.substring_index(c, "@", -1))).otherwise(F.when(c.isNotNull(), F.lit("")))


def token_estimate(*parts: Column) -> Column:
    """Rough number of model tokens: characters over 3.6, cut to a whole number, plus 20."""
    size = sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0))
    return (size / F.lit(3.6)).cast("int") + 20


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def slug(c: Column, size: int = 96) -> Column:
    """Lower-case ASCII name part: other signs become single hyphens."""
    s = F.regexp_replace(fold(c), r"[^a-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^[-.]+|[-.]+$", ""), 1, size)


def bytes_text(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves at least one, B to TiB; ? below zero, null for null."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    value = n.cast("double")
    out = F.when(n < 0, F.lit("?")).when(value < 1024, F.format_string("%.0f B", value))
    for k, unit in enumerate(units[1:-1], 1):
        out = out.when(value < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(value / 1024.0**k, 1)))
    return F.when(n.isNotNull(), out.otherwise(F.format_string("%.1f TiB", F.bround(value / 1024.0**4, 1))))


def cut(c: Column, size: int) -> Column:
    """The first characters of a text, null as empty."""
    return F.coalesce(F.substring(c, 1, size), F.lit(""))
