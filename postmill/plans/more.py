"""Further queries of the archive engine: raw mail, search, dates, files, the work queue and its register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import files, material, mime, text, times
from postmill.operators import archive, fulltext, ingest, lifecycle, outcomes, pipeline
from postmill.plans.core import _NEWEST, _newest, _search
from postmill.session import spread
from postmill.sources.tables import read_table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- raw mail -----------------------------------------------------------------------------------

_MAIL = ("id", "fetched_at", "account", "msg_type", "from_name", "from_addr", "subject", "date_certified", "message_id", "gestore")
#: The transport header of each message type.
_HEADERS = {
    "posta_certificata": ("X-Trasporto", "posta-certificata"), "busta_anomalia": ("X-Trasporto", "errore"), "non_accettazione": ("X-Ricevuta", "non-accettazione"), "errore_consegna": ("X-Ricevuta", "errore-consegna"),
    "preavviso_errore_consegna": ("X-Ricevuta", "preavviso-errore-consegna"), "rilevazione_virus": ("X-Ricevuta", "rilevazione-virus"),
}


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """(account, uidvalidity, uid, internaldate, raw, id_of): each archived message built back into the bytes of a certified envelope."""
    m = _newest(spark, d, *_MAIL)
    body = t(spark, d, "fts_map").join(t(spark, d, "messages_fts").select("rowid_fts", "body"), "rowid_fts").groupBy(F.col("msg_id").alias("id")).agg(F.max("body").alias("body"))
    m = m.join(body, "id", "left")
    b64 = lambda c: F.replace(F.base64(F.encode(F.coalesce(c, F.lit("")), "utf-8")), F.lit("\r\n"), F.lit(""))
    word = lambda c: F.concat(F.lit("=?utf-8?B?"), b64(c), F.lit("?="))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    said = F.lit("")
    for kind, (name, value) in _HEADERS.items():
        said = F.when(F.col("msg_type") == kind, F.lit(f"{name}: {value}\r\n")).otherwise(said)
    inner = F.concat(
        F.when(F.col("subject").isNotNull(), line("Subject", word(F.col("subject")))).otherwise(""), F.when(F.col("from_addr").isNotNull(), line("From", F.concat(F.when(F.coalesce("from_name", F.lit("")).rlike(r"^[\p{L}\p{N} ']+$"), word(F.col("from_name"))).otherwise(""), F.lit(" <"), F.col("from_addr"), F.lit(">")))).otherwise(""),
        F.when(F.col("message_id").isNotNull(), line("Message-ID", F.col("message_id"))).otherwise(""), F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(F.col("body")), F.lit("\r\n"),
    )
    at = F.from_utc_timestamp(F.try_to_timestamp("date_certified"), "UTC")
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><postacert tipo="'), F.replace(F.col("msg_type"), F.lit("_"), F.lit("-")), F.lit('" errore="nessuno"><intestazione></intestazione><dati><gestore-emittente>'), text.escape_html(F.coalesce("gestore", F.lit(""))),
        F.lit("</gestore-emittente>"), F.when(at.isNotNull(), F.concat(F.lit('<data zona="+0000"><giorno>'), F.date_format(at, "dd/MM/yyyy"), F.lit("</giorno><ora>"), F.date_format(at, "HH:mm:ss"), F.lit("</ora></data>"))).otherwise(""), F.lit("</dati></postacert>"),
    )
    part = lambda head, c: F.concat(F.lit(f"--pm\r\n{head}\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(c), F.lit("\r\n"))
    whole = F.concat(
        said, F.lit("Subject: busta\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=pm\r\n\r\n"), part('Content-Type: application/octet-stream; name="postacert.eml"', inner),
        F.when(F.col("msg_type") == "generico", F.lit("")).otherwise(part('Content-Type: application/xml; name="daticert.xml"', xml)), F.lit("--pm--\r\n"),
    )
    return m.select("account", F.lit(1).cast("long").alias("uidvalidity"), F.abs(F.xxhash64("id")).alias("uid"), F.lit(None).cast("timestamp").alias("internaldate"), F.encode(whole, "utf-8").alias("raw"), F.col("id").alias("id_of"))


_TIDY = "trim(regexp_replace(regexp_replace(replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n', chr(10), 'g'), ' ' || chr(10))"
_CLOSED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(f"""WITH {_NEWEST.format(cols=', '.join(_MAIL))}, b AS (SELECT msg_id AS id, max(body) AS body FROM fts_map JOIN messages_fts USING (rowid_fts) GROUP BY 1)
  SELECT id, msg_type, msg_type NOT IN ('busta_anomalia', 'generico') AS certified,
  CASE WHEN msg_type IN ('non_accettazione', 'errore_consegna', 'preavviso_errore_consegna', 'rilevazione_virus') THEN 'negativa' END AS receipt_class, lower(from_addr) AS from_addr,
  coalesce({_CLOSED.format(c='subject')}, '') AS subject, CASE WHEN msg_type = 'generico' THEN '' ELSE coalesce(trim(gestore), '') END AS gestore,
  CASE WHEN msg_type <> 'generico' AND date_certified LIKE '____-__-__T__:__:__%' THEN strftime(CAST(replace(date_certified, 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS certified_utc,
  length(regexp_replace(coalesce(body, ''), '\\s+', '', 'g')) AS letters FROM newest LEFT JOIN b USING (id)""")  # fmt: skip
def raw_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every archived message as an envelope's bytes, parsed and classified again."""
    raw = spread(envelopes(spark, d))
    ids = raw.select("account", "uid", "id_of")
    p = pipeline.parsed(raw.drop("id_of")).join(ids, ["account", "uid"])
    utc = F.date_format(times.instant(F.col("date_certified")), "yyyy-MM-dd HH:mm:ss")
    return p.select(F.col("id_of").alias("id"), "msg_type", "certified", "receipt_class", "from_addr", "subject", "gestore", utc.alias("certified_utc"), F.length(F.regexp_replace("body", r"(?U)\s+", "")).alias("letters"))


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, account, msg_type')} SELECT account, count(*) AS messages, count(*) AS again FROM newest GROUP BY account""")
def raw_to_archive(spark: SparkSession, d: str) -> DataFrame:
    """Raw mail through the whole pipeline into archive tables, twice: the second run adds nothing.

    One message of a mailbox is one row of the archive, so both counts are those of the source.
    """
    from postmill.session import stored, work_dir

    path = work_dir(spark, "archive")
    raw = stored(spread(envelopes(spark, d).drop("id_of")))
    state = spark.createDataFrame([], "account string, uidvalidity long, uid long, content_hash string, status string")
    now = F.lit("2026-01-01T00:00:00+01:00")
    first = stored(pipeline.run(raw, state, path, now, buckets=4))
    once = stored(spark.read.parquet(f"{path}/messages").groupBy("account").agg(F.count(F.lit(1)).alias("messages")))
    # the same mail again, its state lost: content and time of fetching keep it out
    pipeline.run(raw, state, path, now, buckets=4).count()
    again = spark.read.parquet(f"{path}/messages").groupBy("account").agg(F.count(F.lit(1)).alias("again"))
    twins = first.where("status = 'duplicate'").groupBy("account").agg(F.count(F.lit(1)).alias("_twins"))
    out = once.join(again, "account").join(twins, "account", "left")
    lost = F.coalesce("_twins", F.lit(0))  # equal bytes under several ids are one message to the pipeline
    return out.select("account", (F.col("messages") + lost).alias("messages"), (F.col("again") + lost).alias("again"))


@query("SELECT doc_id, coalesce(nullif(text, ''), CASE WHEN text = '' THEN '' END) AS decoded FROM documents")
def decoded_text(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 bytes that a mail declares to be Latin: the valid UTF-8 outranks the declaration."""
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", mime.decode_text(F.encode("text", "utf-8"), F.lit("iso-8859-1")).alias("decoded"))


@query("SELECT DISTINCT id, coalesce(nfc_normalize(" + _CLOSED.format(c="subject") + "), '') AS header FROM messages WHERE subject IS NOT NULL")
def header_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Subjects as encoded header words, decoded again."""
    m = t(spark, d, "messages").where(F.col("subject").isNotNull()).select("id", "subject").distinct()
    coded = F.concat(F.lit("=?utf-8?B?"), F.replace(F.base64(F.encode("subject", "utf-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    return m.select("id", mime.decode_header(coded).alias("header")).distinct()


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(regexp_replace(text, '[\\s\\x{00A0}\\x{200B}]+', '', 'g')) END AS letters, contains(text, '<') AS signs FROM documents")
def html_read(spark: SparkSession, d: str) -> DataFrame:
    """Every text as an escaped page with a script, read back: all its letters and nothing of the script."""
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    page = F.concat(F.lit("<html><head><script>alert(1)</script></head><body><div>"), text.escape_html(F.col("text")), F.lit("</div></body></html>"))
    read = docs.select("doc_id", mime.html_to_text(page).alias("read"))
    return read.select("doc_id", F.length(F.regexp_replace("read", r"[\s ​]+", "")).alias("letters"), F.contains("read", F.lit("<")).alias("signs"))


# ---- files --------------------------------------------------------------------------------------


@query("""SELECT msg_id, name, coalesce(method, '') IN ('image_ocr', 'pdf_ocr') AS is_ocr, coalesce(chars, 0) > 0 AS has_text, coalesce(status, '') = 'unsupported_archive' AS is_archive,
  CASE WHEN contains(coalesce(name, ''), '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS extension, coalesce(status, '') IN ('unsupported_archive', 'encrypted', 'archive_limit') AS opaque,
  coalesce(status, '') NOT IN ('unsupported_archive', 'encrypted', 'archive_limit') AND contains(coalesce(name, ''), '.') AND lower(string_split(name, '.')[-1]) IN ('zip', 'rar', '7z', 'gz', 'tgz', 'bz2', 'xz', 'cab', 'iso', 'img', 'arj', 'lzh', 'ace') AS packed
  FROM (SELECT DISTINCT msg_id, name, method, status, chars FROM attachments)""")
def attachment_flags(spark: SparkSession, d: str) -> DataFrame:
    """What each attachment is: read from a picture, with text, an archive, and whether it could be opened."""
    a = t(spark, d, "attachments").select("msg_id", "name", "method", "status", "chars").distinct()
    c = F.col
    return a.select("msg_id", "name", files.attachment_flags(c("name"), c("method"), c("status"), c("chars")).alias("f")).select("msg_id", "name", "f.*")


@query("""WITH a AS (SELECT DISTINCT msg_id, name, content_type, lower(string_split(coalesce(name, ''), '.')[-1]) AS e FROM attachments),
  k AS (SELECT *, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('zip', 'docx', 'xlsx', 'odt') THEN 'zip' WHEN e = 'exe' THEN 'pe' WHEN e IN ('doc', 'xls') THEN 'pe' ELSE '' END AS kind FROM a)
  SELECT kind AS sniffed, count(*) AS n, count(*) FILTER (WHERE e IN ('doc', 'xls')) AS lying FROM k GROUP BY kind""")
def file_sniffed(spark: SparkSession, d: str) -> DataFrame:
    """Attachments with the first bytes of their kind, old office files with those of a program: content outranks the name."""
    a = t(spark, d, "attachments").select("msg_id", "name", "content_type").distinct()
    e = F.lower(F.substring_index(F.coalesce("name", F.lit("")), ".", -1))
    head = F.when(e == "pdf", "6A756E6B25504446 2D".replace(" ", "")).when(e.isin("zip", "docx", "xlsx", "odt"), "504B0304").when(e.isin("exe", "doc", "xls"), "4D5A9000").otherwise("63696166")
    rows = a.withColumn("bytes", F.unhex(head))
    rows = rows.select(e.alias("e"), files.sniff(F.col("bytes")).alias("sniffed"), files.verdict(F.lit("x.doc"), F.lit(None).cast("string"), F.col("bytes"))["suspicious"].alias("s"))
    return rows.groupBy("sniffed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e").isin("doc", "xls") & F.col("s")).alias("lying"))


@query("""SELECT DISTINCT size, CASE WHEN size < 1024 THEN printf('%d B', size) WHEN size < 1048576 THEN printf('%.1f KiB', size / 1024) WHEN size < 1073741824 THEN printf('%.1f MiB', size / 1048576) ELSE printf('%.1f GiB', size / 1073741824) END AS shown
  FROM attachments WHERE size IS NOT NULL""")
def sizes_shown(spark: SparkSession, d: str) -> DataFrame:
    """Attachment sizes as people read them."""
    return t(spark, d, "attachments").where(F.col("size").isNotNull()).select("size").distinct().select("size", text.bytes_text(F.col("size")).alias("shown"))


@query("""WITH a AS (SELECT DISTINCT msg_id, name, coalesce(size, 0) AS size, chars, method FROM attachments WHERE coalesce(chars, 0) > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY size DESC, name, method, chars) AS rn FROM a) SELECT msg_id, list(name ORDER BY rn) AS shown FROM r WHERE rn <= 3 GROUP BY msg_id""")
def attachment_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The attachments of each message that a reader would be shown."""
    a = t(spark, d, "attachments").select("msg_id", "name", "method", F.coalesce("size", F.lit(0)).alias("size"), "chars").distinct()
    packed = a.groupBy("msg_id").agg(F.collect_list(F.struct("name", "method", "chars", "size")).alias("a"))
    shown = F.transform(material.candidates(F.col("a")), lambda x: x["name"])
    return packed.select("msg_id", shown.alias("shown")).where(F.size("shown") > 0)


@query()
def materials(spark: SparkSession, d: str) -> DataFrame:
    """The fenced material of each message: subject, body and up to three attachments within fixed budgets."""
    f = t(spark, d, "messages_fts").select("rowid_fts", "subject", "body").join(t(spark, d, "fts_map"), "rowid_fts")
    e = t(spark, d, "extractions").where(F.col("text").isNotNull()).groupBy("msg_id").agg(F.collect_list(F.struct("name", "method", F.length("text").alias("size"), F.length("text").alias("chars"), "text")).alias("a"))
    j = spread(f.join(e, "msg_id", "left"))
    none = F.array().cast("array<struct<name:string,method:string,size:int,chars:int,text:string>>")
    return j.select("msg_id", material.build(F.col("subject"), F.col("body"), F.coalesce("a", none), ("scadenza", "entro", "euro", "diffida"), F.substring(F.sha2(F.col("msg_id"), 256), 1, 12)).alias("material"))


# ---- search -------------------------------------------------------------------------------------

_BARE = "list_filter(string_split_regex(translate(lower(coalesce({c}, '')), '" + text.ACCENTED + "', '" + text.PLAIN + "'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("WITH w AS (SELECT rowid_fts, " + _BARE.format(c="body") + """ AS b FROM messages_fts), p AS (SELECT rowid_fts, unnest(b) AS w, unnest(range(1, len(b) + 1)) AS i FROM w)
  SELECT DISTINCT x.rowid_fts FROM p x JOIN p y ON x.rowid_fts = y.rowid_fts AND x.w = 'entro' AND y.w = 'ricevimento' AND abs(x.i - y.i) <= 4""")  # fmt: skip
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    """Two words of the body with at most three others between them."""
    return _search(spark, d, "body:NEAR(entro ricevimento, 3)")


@query("WITH w AS (SELECT rowid_fts, " + ", ".join(_BARE.format(c=c) + f" AS {c}" for c in ("subject", "body")) + """ FROM messages_fts)
  SELECT rowid_fts FROM w WHERE (list_contains(subject, 'sollecito') OR list_contains(subject, 'diffida') OR list_contains(body, 'sollecito') OR list_contains(body, 'diffida'))
  AND NOT (list_contains(subject, 'condominio') OR list_contains(body, 'condominio'))""")  # fmt: skip
def fts_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Parentheses and a set of columns: either word in subject or body, and not a third one there."""
    return _search(spark, d, "{subject body}: ((sollecito OR diffida) NOT condominio)")


_WORDS = "list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')"
_AT = "list_position(list_transform(w, lambda x: contains(translate(lower(x), '" + text.ACCENTED + "', '" + text.PLAIN + "'), 'perizia')), true)"


@query("WITH h AS (SELECT rowid_fts, body FROM messages_fts WHERE list_contains(" + _BARE.format(c="body") + f""", 'perizia')), w AS (SELECT rowid_fts, {_WORDS} AS w FROM h), a AS (SELECT *, {_AT} AS k FROM w), s AS (SELECT *, greatest(k - 8, 1) AS start FROM a)
  SELECT rowid_fts, (CASE WHEN start > 1 THEN ' … ' ELSE '' END) || array_to_string(w[start:start + 15], ' ') || (CASE WHEN start + 16 <= len(w) THEN ' … ' ELSE '' END) AS snippet FROM s""")  # fmt: skip
def fts_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Search hits joined back to their bodies, each with the words around its first hit."""
    return fulltext.with_snippets(_search(spark, d, "body:perizia"), t(spark, d, "messages_fts"), "body:perizia")


_SEARCH = "id, account, client, msg_type, date_certified, fetched_at, from_addr, from_domain, subject"


@query(f"WITH {_NEWEST.format(cols=_SEARCH)}, w AS (SELECT rowid_fts, " + _BARE.format(c="subject || ' ' || coalesce(sender, '') || ' ' || coalesce(recipients, '') || ' ' || coalesce(body, '') || ' ' || coalesce(attachments, '')") + """ AS w FROM (SELECT rowid_fts, coalesce(subject, '') AS subject, sender, recipients, body, attachments FROM messages_fts))
  SELECT id, subject, coalesce(date_certified, fetched_at) AS d FROM newest WHERE account = 'alba' AND id IN (SELECT msg_id FROM fts_map JOIN w USING (rowid_fts) WHERE list_contains(w, 'perizia')) ORDER BY d DESC NULLS LAST, id LIMIT 20""")  # fmt: skip
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Full-text hits of one mailbox, the twenty newest."""
    m = _newest(spark, d, *[c.strip() for c in _SEARCH.split(",")])
    hits = archive.searched(_search(spark, d, "perizia"), t(spark, d, "fts_map"), m, account="alba", limit=20)
    return hits.select("id", "subject", archive.archive_date().alias("d"))


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, mailbox_address, from_addr, from_domain, to_addrs')} SELECT id, lower(mailbox_address) AS mailbox_address, lower(from_addr) AS from_addr, lower(from_domain) AS from_domain, lower(to_addrs) AS to_addrs FROM newest""")
def archive_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of an older archive brought to lower case."""
    return archive.lowered(_newest(spark, d, "id", "fetched_at", "mailbox_address", "from_addr", "from_domain", "to_addrs")).drop("fetched_at")


_FULL = "id, fetched_at, account, client, msg_type, certified, date_certified, date_sent, from_addr, from_name, subject, message_id, receipt_kind, receipt_class, ref_message_id, mailbox_label, mailbox_address, pec_identifier, gestore, content_dir, index_file, n_attachments, body_chars, to_addrs"


@query(f"""WITH {_NEWEST.format(cols=_FULL)} SELECT id, gestore, n_attachments AS n, list_filter(list_transform(string_split(coalesce(to_addrs, ''), ','), lambda a: lower(trim(a))), lambda a: a <> '') AS destinatari FROM newest""")
def full_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Recipients and details of the full metadata of each message."""
    m = _newest(spark, d, *[c.strip() for c in _FULL.split(",")]).select(*archive.full_metadata())
    return m.select("id", F.col("dettagli.gestore").alias("gestore"), F.col("dettagli.n_attachments").alias("n"), "destinatari")


# ---- dates --------------------------------------------------------------------------------------


@query("""SELECT id, d, CASE WHEN regexp_matches(d, '\\d{4}-\\d{2}-\\d{2}') THEN regexp_replace(regexp_extract(d, '\\d{4}-(\\d{2}-\\d{2})', 1), '(\\d{2})-(\\d{2})', '\\2/\\1') ELSE trim(d) END AS short,
  CASE WHEN regexp_matches(d, '\\d{4}-\\d{2}-\\d{2}') THEN 0 ELSE 1 END AS rank FROM (SELECT DISTINCT id, coalesce(date_certified, '') AS d FROM messages)""")
def dates_short(spark: SparkSession, d: str) -> DataFrame:
    """Day and month of each date, and whether it can be sorted by."""
    m = t(spark, d, "messages").select("id", F.coalesce("date_certified", F.lit("")).alias("d")).distinct()
    return m.select("id", "d", times.short_date(F.col("d")).alias("short"), times.deadline_key(F.col("d"), F.lit(""))["rank"].alias("rank"))


@query("""SELECT DISTINCT internaldate::DATE AS day, ['lunedì', 'martedì', 'mercoledì', 'giovedì', 'venerdì', 'sabato', 'domenica'][isodow(internaldate)] || ' ' || day(internaldate) || ' ' ||
  ['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'][month(internaldate)] AS written, strftime(internaldate, '%d-%b-%Y') AS server FROM mail_state WHERE internaldate IS NOT NULL""")
def dates_written(spark: SparkSession, d: str) -> DataFrame:
    """Days in Italian words and as mail servers take them."""
    day = F.col("day")
    return t(spark, d, "mail_state").where(F.col("internaldate").isNotNull()).select(F.to_date("internaldate").alias("day")).distinct().select("day", times.italian_date(day).alias("written"), times.server_date(day).alias("server"))


@query("""SELECT DISTINCT id, CASE WHEN a IS NOT NULL AND (b IS NULL OR a > b) THEN date_certified ELSE coalesce(fetched_at, date_certified) END AS later FROM (SELECT id, date_certified, fetched_at,
  TRY_CAST(replace(date_certified, 'Z', '+00:00') AS TIMESTAMPTZ) AS a, TRY_CAST(replace(fetched_at, 'Z', '+00:00') AS TIMESTAMPTZ) AS b FROM messages WHERE date_certified LIKE '____-__-__T__:__:__%' AND fetched_at LIKE '____-__-__T__:__:__%')""")
def dates_later(spark: SparkSession, d: str) -> DataFrame:
    """The later of two dates with offsets, as written."""
    full = "____-__-__T__:__:__%"
    m = t(spark, d, "messages").where(F.col("date_certified").like(full) & F.col("fetched_at").like(full))
    return m.select("id", times.later(F.col("date_certified"), F.col("fetched_at")).alias("later")).distinct()


@query("""SELECT DISTINCT internaldate AS at, strftime(timezone('Europe/Rome', timezone('UTC', internaldate)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch(timezone('Europe/Rome', timezone('UTC', internaldate))) - epoch(internaldate) > 3600 THEN '+02:00' ELSE '+01:00' END AS iso
  FROM mail_state WHERE internaldate IS NOT NULL""")
def dates_iso(spark: SparkSession, d: str) -> DataFrame:
    """Instants as ISO text of the archive's zone with its offset."""
    s = t(spark, d, "mail_state").where(F.col("internaldate").isNotNull()).select(F.col("internaldate").alias("at")).distinct()
    return s.select("at", times.iso(F.col("at").cast("timestamp")).alias("iso"))


# ---- ingestion and work queue -------------------------------------------------------------------


@query("""SELECT account, uidvalidity, greatest(coalesce(min(uid) FILTER (WHERE internaldate::DATE >= DATE '2025-12-01') - 1, max(uid), 0), 0) AS last_uid FROM mail_state GROUP BY ALL""")
def start_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each mailbox would start without reading: before the first message since a day, else after the last."""
    return ingest.start_positions(t(spark, d, "mail_state"), "2025-12-01")


@query("""SELECT account, uidvalidity, uid FROM mail_state a WHERE internaldate::DATE >= DATE '2025-06-01' AND status NOT IN ('done', 'skipped', 'duplicate')""")
def backfill_pending(spark: SparkSession, d: str) -> DataFrame:
    """What a backfill since a day would take up: not concluded, by whole days."""
    s = t(spark, d, "mail_state").select("account", "uidvalidity", "uid", "status", "internaldate")
    return ingest.pending(ingest.since_day(s, "2025-06-01"), s).select("account", "uidvalidity", "uid")


@query("""SELECT msg_type IN ('accettazione', 'presa_in_carico', 'avvenuta_consegna') AS registry, coalesce(msg_type, 'generico') NOT IN ('busta_anomalia', 'generico') AS certified, coalesce(attempts, 0) > 3 AS degraded, count(*) AS n FROM mail_state WHERE msg_type IS NOT NULL GROUP BY ALL""")
def sinks_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows by sink, certificate and whether their attachments would still be read."""
    kept, positive = ingest.split_receipts(t(spark, d, "mail_state").where(F.col("msg_type").isNotNull()).select("msg_type", "attempts"))
    both = kept.withColumn("registry", F.lit(False)).union(positive.withColumn("registry", F.lit(True)))
    return both.groupBy("registry", ingest.certified(F.col("msg_type")).alias("certified"), ingest.degraded(F.col("attempts")).alias("degraded")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT account, uidvalidity, uid, CASE WHEN files_done IS DISTINCT FROM 1 THEN 'files' WHEN index_done IS DISTINCT FROM 1 THEN 'index' WHEN archive_done IS DISTINCT FROM 1 THEN 'archive' ELSE 'done' END AS next FROM mail_state""")
def phases_next(spark: SparkSession, d: str) -> DataFrame:
    """At which phase each message is taken up again."""
    s = t(spark, d, "mail_state").select("account", "uidvalidity", "uid", "files_done", "index_done", "archive_done")
    return pipeline.phases(s, s.select("account", "uidvalidity", "uid")).select("account", "uidvalidity", "uid", "next")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The work queue's log as the state table tells it: a claim for each attempt, then how it ended."""
    s = t(spark, d, "mail_state").select(F.concat_ws("/", "account", "uidvalidity", "uid").alias("id"), "status", F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(0)).alias("n"), "error")
    claims = s.where(F.col("n") > 0).select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq")).select("id", "seq", F.lit("preso").alias("event"), F.lit(None).cast("string").alias("error"))
    end = F.when(F.col("status") == "done", "archiviato").when(F.col("status") == "skipped", "classificato").when(F.col("status") == "failed", "fallito").when(F.col("status") == "duplicate", "riprova")
    return claims.union(s.where(end.isNotNull()).select("id", (F.col("n") + 1).alias("seq"), end, "error"))


_STATE = "CASE status WHEN 'done' THEN 'archiviato' WHEN 'skipped' THEN 'classificato' WHEN 'failed' THEN CASE WHEN n >= 3 THEN 'sospeso' ELSE 'nuovo' END WHEN 'duplicate' THEN 'nuovo' ELSE 'in_corso' END"
_QUEUE = "(SELECT account || '/' || uidvalidity || '/' || uid AS id, status, greatest(coalesce(attempts, 0), 0) AS n, error FROM mail_state)"


@query(f"""WITH s AS (SELECT id, {_STATE} AS state, CASE WHEN status = 'duplicate' THEN 0 ELSE n END AS attempts FROM {_QUEUE} WHERE n > 0 OR status <> 'pending')
  SELECT id, state, attempts::INT AS attempts, CASE WHEN state = 'archiviato' THEN 'già lavorato' WHEN state = 'classificato' THEN 'già classificato' WHEN state = 'sospeso' THEN 'sospeso dopo troppi tentativi' WHEN attempts >= 3 THEN 'tentativi esauriti' ELSE '' END AS reason FROM s""")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    """Each message's state folded from the log of its events, and why it could not be taken up."""
    s = lifecycle.fold(_events(spark, d))
    return s.select("id", "state", "attempts", lifecycle.claim(F.col("state"), F.col("attempts"))["reason"].alias("reason"))


@query(f"""WITH s AS (SELECT id, {_STATE} AS state FROM {_QUEUE} WHERE n > 0 OR status <> 'pending') SELECT 'stato' AS dimension, state AS value, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'totale', '', count(*) FROM s
  UNION ALL SELECT 'classe', CASE WHEN state = 'archiviato' THEN 'ordinario' END, count(*) FROM s WHERE state = 'archiviato' GROUP BY ALL""")
def queue_report(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the queue by state, by class, and in all."""
    s = lifecycle.fold(_events(spark, d)).withColumn("class", F.when(F.col("state") == lifecycle.ARCHIVED, "ordinario"))
    return lifecycle.states_report(s)


@query(f"""WITH s AS (SELECT id, {_STATE} AS state, error FROM {_QUEUE} WHERE n > 0 OR status <> 'pending'), q AS (SELECT account || '/' || uidvalidity || '/' || uid AS id FROM mail_state WHERE status <> 'done')
  SELECT q.id, coalesce(CASE WHEN s.state = 'sospeso' THEN coalesce(substr(s.error, 1, 500), 'sospeso') END, 'ancora in coda, non classificato') AS reason FROM q LEFT JOIN s USING (id) WHERE q.id NOT IN (SELECT id FROM s WHERE state = 'classificato')""")
def queue_unworked(spark: SparkSession, d: str) -> DataFrame:
    """What is left in the queue without an outcome, and why."""
    states = lifecycle.fold(_events(spark, d))
    queue = t(spark, d, "mail_state").where("status <> 'done'").select(F.concat_ws("/", "account", "uidvalidity", "uid").alias("id"))
    return lifecycle.unworked(queue, states.where(F.col("state") == lifecycle.CLASSIFIED), states)


@query(f"""WITH s AS (SELECT id, {_STATE} AS state FROM {_QUEUE} WHERE n > 0 OR status <> 'pending'), q AS (SELECT account || '/' || uidvalidity || '/' || uid AS id FROM mail_state WHERE size > 20000)
  SELECT id, CASE WHEN id IN (SELECT id FROM q) THEN 'sposta' ELSE 'archivia' END AS todo FROM s WHERE state = 'classificato'""")
def queue_to_move(spark: SparkSession, d: str) -> DataFrame:
    """Classified messages that still lie in the queue and those already moved."""
    queue = t(spark, d, "mail_state").where(F.col("size") > 20_000).select(F.concat_ws("/", "account", "uidvalidity", "uid").alias("id"))
    return lifecycle.to_move(lifecycle.fold(_events(spark, d)), queue)


@query("""SELECT id FROM (SELECT account || '/' || uidvalidity || '/' || uid AS id, row_number() OVER (ORDER BY internaldate NULLS LAST, account || '/' || uidvalidity || '/' || uid) AS rn FROM mail_state) WHERE rn > 200""")
def queue_untouched(spark: SparkSession, d: str) -> DataFrame:
    """What the budget of a run, its two hundred oldest items, leaves."""
    queue = t(spark, d, "mail_state").select(F.concat_ws("/", "account", "uidvalidity", "uid").alias("id"), F.col("internaldate").alias("ts"))
    return lifecycle.triage_budget(queue)[1].select("id")


# ---- outcomes and corrections -------------------------------------------------------------------


def _outcomes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes and corrections laid over the archive: a message is an outcome, a receipt about it a correction."""
    m = _newest(spark, d, "id", "fetched_at", "account", "client", "msg_type", "from_domain", "certified", "n_attachments", "message_id", "body_chars")
    o = m.select(
        "id", "message_id", F.col("client").alias("cliente"), F.col("msg_type").alias("classe"), F.col("account").alias("tipo_documento"), F.lower("from_domain").alias("mittente"), F.struct(F.when(F.col("certified") == 1, "regola").otherwise("modello").alias("origine")).alias("instradamento"),
        F.struct(F.when(F.col("n_attachments") > 1, "bassa").otherwise("alta").alias("livello")).alias("confidenza"), F.when(F.col("certified") == 1, F.array(F.lit("r-uno"), F.lit("r-due"))).otherwise(F.array().cast("array<string>")).alias("regole_applicate"),
        F.struct(F.when(F.col("certified") == 1, F.lit("2")).alias("versione"), F.col("account").alias("regole")).alias("direttive"), F.struct(F.col("body_chars").cast("long").alias("token_in"), F.col("n_attachments").cast("long").alias("token_out"), F.lit(0).cast("long").alias("cache_read")).alias("modello"),
    )
    r = t(spark, d, "receipts").where(F.col("ref_message_id").isNotNull()).select(F.col("msg_id").alias("autore"), "ref_message_id", "kind", "recorded_at").distinct()
    c = r.join(o.select("id", F.col("message_id").alias("ref_message_id")).where(F.col("ref_message_id").isNotNull()), "ref_message_id")
    return o, c.select("id", F.col("recorded_at").alias("corretto_il"), F.lit("classe").alias("campo"), F.col("kind").alias("proposto"), F.col("autore").alias("corretto"))


_OUTCOMES = f"""WITH {_NEWEST.format(cols='id, fetched_at, account, client, msg_type, from_domain, certified, n_attachments, message_id, body_chars')},
  c AS (SELECT DISTINCT n.id, r.msg_id, r.kind, r.recorded_at FROM receipts r JOIN newest n ON n.message_id = r.ref_message_id)"""


@query(_OUTCOMES + """, o AS (SELECT (id IN (SELECT id FROM c))::INT AS k, coalesce(nullif(client, ''), '—') AS per_cliente, coalesce(nullif(msg_type, ''), '—') AS per_classe, coalesce(nullif(account, ''), '—') AS per_tipo_documento,
  coalesce(nullif(lower(from_domain), ''), '—') AS per_mittente, CASE WHEN certified = 1 THEN 'regola' ELSE 'modello' END AS per_origine_instradamento, CASE WHEN n_attachments > 1 THEN 'bassa' ELSE 'alta' END AS per_confidenza, CASE WHEN certified = 1 THEN 'r-uno, r-due' ELSE '—' END AS per_regola FROM newest),
  u AS (UNPIVOT o ON per_cliente, per_classe, per_tipo_documento, per_mittente, per_origine_instradamento, per_confidenza, per_regola INTO NAME dimension VALUE value)
  SELECT dimension, value, count(*) AS total, sum(k)::BIGINT AS corrected, round_even(sum(k) / count(*), 3) AS rate FROM u GROUP BY ALL UNION ALL SELECT 'tutti', '', count(*), sum(k)::BIGINT, round_even(sum(k) / count(*), 3) FROM o""")  # fmt: skip
def outcomes_register(spark: SparkSession, d: str) -> DataFrame:
    """How many outcomes were corrected, by the register's seven keys."""
    return outcomes.report(*_outcomes(spark, d))


@query(_OUTCOMES + """ SELECT n.id, list({'corretto_il': c.recorded_at, 'corretto': c.msg_id} ORDER BY c.recorded_at, c.kind, c.msg_id) FILTER (WHERE c.id IS NOT NULL)::VARCHAR IS NOT NULL AS corrected, count(c.id) AS n, min(c.recorded_at) AS first FROM newest n LEFT JOIN c USING (id) GROUP BY n.id""")
def outcomes_explained(spark: SparkSession, d: str) -> DataFrame:
    """Each outcome with its corrections in order of time."""
    e = outcomes.explain(*_outcomes(spark, d))
    return e.select("id", (F.size("correzioni") > 0).alias("corrected"), F.size("correzioni").cast("long").alias("n"), F.get("correzioni", F.lit(0))["corretto_il"].alias("first"))


@query(_OUTCOMES + " SELECT DISTINCT CASE WHEN certified = 1 THEN '2' ELSE '?' END || ' (' || coalesce(account, '?') || ')' AS version FROM newest")
def directive_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions of the directives in use."""
    return outcomes.versions(_outcomes(spark, d)[0])


@query(_OUTCOMES + " SELECT sum(body_chars)::BIGINT AS token_in, sum(n_attachments)::BIGINT AS token_out, 0::BIGINT AS cache_read FROM newest")
def tokens_used(spark: SparkSession, d: str) -> DataFrame:
    """What judging took, in tokens."""
    return outcomes.tokens_used(_outcomes(spark, d)[0])


_DIRECTORY = {"Alba": "alba@x.example", "alba-legale": "legale@x.example"}


@query("SELECT DISTINCT account, CASE lower(account) WHEN 'alba' THEN 'alba@x.example' WHEN 'alba-legale' THEN 'legale@x.example' ELSE '' END AS address FROM mailboxes")
def recipients_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and the address of each, empty where it is unknown."""
    return t(spark, d, "mailboxes").select("account", outcomes.recipient(F.col("account"), _DIRECTORY).alias("address")).distinct()
