"""Declared conditions compiled to Columns: AND between conditions, OR within one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import files

#: condition name to (column, how it is compared). Fixed values.
CONDITIONS = {
    "mittente": ("from_addr", "lower_in"), "mittente_dominio": ("from_domain", "domain"), "casella": ("account", "in"), "cliente": ("client", "in"), "tipo": ("msg_type", "in"),
    "certificato": ("certified", "flag"), "ha_allegati": ("n_attachments", "some"), "oggetto_regex": ("subject", "regex"), "allegato_estensione": ("attachment_names", "ending"), "allegato_nome_regex": ("attachment_names", "names"),
}


def condition(name: str, values) -> Column:
    """One condition; an unknown name raises KeyError, a null field does not meet it."""
    column, how = CONDITIONS[name]
    c = F.col(column)
    listed = values if isinstance(values, list | tuple) else [values]
    if how == "lower_in":
        out = F.lower(c).isin(*[v.lower() for v in listed])
    elif how == "in":
        out = c.isin(*listed)
    elif how == "domain":
        out = F.lit(False)
        for v in listed:
            out = out | (F.lower(c) == v.lower()) | F.lower(c).endswith("." + v.lower())
    elif how == "flag":
        out = c == int(bool(values))
    elif how == "some":
        out = (c > 0) == F.lit(bool(values))
    elif how == "regex":
        out = c.rlike("|".join(f"(?:{v})" for v in listed))
    elif how == "ending":
        out = F.exists(c, lambda n: files.extension(n).isin(*[v.lower().lstrip(".") for v in listed]))
    else:
        out = F.exists(c, lambda n: n.rlike("|".join(f"(?:{v})" for v in listed)))
    return F.coalesce(out, F.lit(False))


def compile_rule(when: dict) -> Column:
    """All conditions of a rule as one expression; no condition meets every row."""
    out = F.lit(True)
    for name, values in when.items():
        out = out & condition(name, values)
    return out


def matched(rules: list[dict]) -> Column:
    """Ids of the rules that a row meets, by falling priority; equal priorities keep their order."""
    ranked = sorted(rules, key=lambda r: -r.get("priorita", 0))
    return F.array_compact(F.array(*[F.when(compile_rule(r.get("quando", {})), F.lit(r["id"])) for r in ranked])) if ranked else F.array().cast("array<string>")
