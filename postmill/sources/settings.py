"""Configuration and directives on the driver: TOML read and merged, checked, fingerprinted, shown without secrets."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import re
import shutil
import time
import tomllib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.rules import CONDITIONS

#: What a rule may ask for, and settings that are never shown.
ACTIONS = ("instradamento", "a", "attenzione", "etichetta", "salta_modello", "sospetto")
SECRET = re.compile(r"pass|secret|token|key", re.I)


def merged(*layers: dict) -> dict:
    """Nested settings, later layers over earlier ones; tables are merged, anything else is replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(*paths: str) -> dict:
    """The TOML files that exist, merged in order; the first one must exist."""
    files = [p for k, p in enumerate(paths) if k == 0 or os.path.exists(p)]
    return merged(*[tomllib.loads(Path(p).read_text(encoding="utf-8")) for p in files])


def accounts(spark: SparkSession, settings: dict) -> DataFrame:
    """(account, client, address, host, enabled) of the configured mailboxes."""
    rows = [(a.get("id"), a.get("cliente"), (a.get("indirizzo") or "").lower(), a.get("host"), bool(a.get("attiva", True))) for a in settings.get("caselle", [])]
    return spark.createDataFrame(rows, "account string, client string, address string, host string, enabled boolean")


def shown(settings: dict) -> dict:
    """The settings with every secret that is set as ***."""
    if isinstance(settings, dict):
        return {k: "***" if SECRET.search(k) and v and not isinstance(v, dict | list) else shown(v) for k, v in settings.items()}
    return [shown(x) for x in settings] if isinstance(settings, list) else settings


def fingerprint(content: bytes) -> str:
    """16 hexadecimal digits that name a version of a file."""
    return hashlib.sha256(content).hexdigest()[:16]


def unknown(found: dict, allowed, what: str) -> list[str]:
    """Names that a vocabulary does not hold, as messages."""
    return [f"{what}: unknown {name}" for name in sorted(set(found) - set(allowed))]


def directives(path: str, instructions: str | None = None) -> dict:
    """{rules, recipients, keywords, version, fingerprints} of a directives file; anything it may not say raises ValueError.

    Rules keep their order; aliases are lower case; a target is an address or a declared alias.
    """
    raw = Path(path).read_bytes()
    d = tomllib.loads(raw.decode("utf-8"))
    recipients = {k.lower(): v for k, v in d.get("destinatari", {}).items()}
    problems, seen = [], set()
    for n, rule in enumerate(d.get("regola", []), 1):
        name, when, then = rule.get("id") or f"regola {n}", rule.get("quando", {}), rule.get("allora", {})
        problems += [f"{name}: twice"] if name in seen else []
        seen.add(name)
        problems += unknown(when, CONDITIONS, name) + unknown(then, ACTIONS, name)
        for key in ("oggetto_regex", "allegato_nome_regex"):
            for pattern in when.get(key, []):
                try:
                    re.compile(pattern)
                except re.error as e:
                    problems.append(f"{name}: {key} {pattern!r}: {e}")
        target = str(then.get("a", "")).strip()
        if target and "@" not in target and target.lower() not in recipients:
            problems.append(f"{name}: no recipient {target}")
    if problems:
        raise ValueError("; ".join(problems))
    prints = {"regole": fingerprint(raw)}
    if instructions:
        prints["istruzioni"] = fingerprint(Path(instructions).read_bytes())
    return {"rules": d.get("regola", []), "recipients": recipients, "keywords": d.get("parole_chiave", {}), "version": str(d.get("versione", "?")), "fingerprints": prints}


def room(paths: list[str], least: int, margin: int = 0) -> str:
    """Empty where every file system of the paths keeps ``least`` bytes free after ``margin`` more, else which one does not."""
    seen = set()
    for path in paths:
        with contextlib.suppress(OSError):
            device = os.stat(path).st_dev
            if device not in seen and shutil.disk_usage(path).free - margin < least:
                return f"{path}: {shutil.disk_usage(path).free} bytes free, {margin} to write, {least} to keep"
            seen.add(device)
    return ""


def clean_staging(root: str, age: int = 86_400) -> int:
    """Remove what interrupted runs left in the staging folder for longer than ``age`` seconds; how many entries went."""
    removed = 0
    for entry in os.scandir(root) if os.path.isdir(root) else []:
        if time.time() - entry.stat().st_mtime > age:
            shutil.rmtree(entry.path, ignore_errors=True) if entry.is_dir() else os.remove(entry.path)
            removed += 1
    return removed


@contextlib.contextmanager
def single_writer(path: str) -> Iterator[None]:
    """Hold the lock file of a run; a second run of the same work is refused."""
    with open(path, "a+", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"{path} is held by another run") from e
        f.seek(0)
        f.truncate()
        f.write(str(os.getpid()))
        f.flush()
        yield


def journal(spark: SparkSession, path: str, mode: str, results: DataFrame, started: str, finished: str) -> DataFrame:
    """Append one run to the journal: accounts that went well and badly, messages written and skipped, exit code.

    ``results`` has account, written, skipped and error (null where all went well).
    """
    bad = F.count_if(F.col("error").isNotNull())
    row = results.agg(F.count_if(F.col("error").isNull()).alias("accounts_ok"), bad.alias("accounts_err"), F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.when(bad > 0, 1).otherwise(0).alias("exit_code"))
    row = row.select(F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), F.lit(mode).alias("mode"), "*")
    row.write.mode("append").json(path)
    return row


def mailbox_name(name: str) -> str:
    """A folder name as mail servers take it: quoted, signs outside ASCII in modified UTF-7."""
    import base64

    def shifted(m: re.Match) -> str:
        if m[0] == "&":
            return "&-"
        return "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-"

    coded = re.sub(r"&|[^\x20-\x7e]+", shifted, name)
    return '"' + re.sub(r'(["\\])', r"\\\1", coded) + '"'
