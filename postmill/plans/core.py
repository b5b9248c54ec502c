"""Queries of the archive engine over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import files, mime, text, times
from postmill.operators import archive, fulltext, history, ingest, register, rules
from postmill.session import spread, work_dir
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


# ---- archive: newest versions, search, statistics ---------------------------------------------

_SEARCH = ["id", "account", "client", "msg_type", "date_certified", "date_sent", "fetched_at", "from_addr", "from_domain", "subject"]
_NEWEST = """newest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM
  (SELECT DISTINCT {cols} FROM messages)) WHERE rn = 1)"""


def _newest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return archive.newest(t(spark, d, "messages").select(*columns))


@query("SELECT id, max(fetched_at) AS fetched_at, count(*) AS versions FROM messages GROUP BY id")
def archive_newest(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins: each message's newest row and how many rows it had."""
    return archive.newest(t(spark, d, "messages").select("id", "fetched_at"), count="versions")


@query(f"WITH {_NEWEST.format(cols='id, msg_type, date_certified, fetched_at')} SELECT msg_type, count(*) AS n, min(coalesce(date_certified, fetched_at)) AS first_date, max(coalesce(date_certified, fetched_at)) AS last_date FROM newest GROUP BY msg_type")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    """Messages by type with first and last date."""
    return archive.stats(_newest(spark, d, "id", "msg_type", "date_certified", "fetched_at"))


@query(f"""WITH {_NEWEST.format(cols=', '.join(_SEARCH))} SELECT id, coalesce(date_certified, fetched_at) AS d, subject FROM newest
  WHERE msg_type = 'posta_certificata' AND (from_addr ILIKE '%corriera%' OR from_domain ILIKE '%corriera%') ORDER BY coalesce(date_certified, fetched_at) DESC NULLS LAST, id LIMIT 30""")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The thirty newest certified messages of a sender's domain."""
    return archive.search(_newest(spark, d, *_SEARCH), sender="corriera", msg_type="posta_certificata", limit=30).select("id", archive.archive_date().alias("d"), "subject")


@query(f"""WITH {_NEWEST.format(cols=', '.join(_SEARCH))} SELECT id, account, coalesce(date_certified, fetched_at) AS d FROM newest
  WHERE coalesce(date_certified, fetched_at) >= '2025-03-01' AND coalesce(date_certified, fetched_at) < '2025-07-01'""")
def search_since_until(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a range of days; the last day counts whole."""
    return archive.search(_newest(spark, d, *_SEARCH), since="2025-03-01", until="2025-06-30", limit=None).select("id", "account", archive.archive_date().alias("d"))


@query(f"WITH {_NEWEST.format(cols=', '.join(_SEARCH))} SELECT id, client, account FROM newest WHERE client = 'alba' OR account = 'alba'")
def search_client(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a client or, by the same word, of a mailbox."""
    return archive.search(_newest(spark, d, *_SEARCH), client="alba", limit=None).select("id", "client", "account")


_FOLD = f"translate(lower(coalesce({{c}}, '')), '{text.ACCENTED}', '{text.PLAIN}')"
_WORDS = "(' ' || trim(regexp_replace(" + _FOLD + ", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


_INDEXES: dict[tuple[str, str], str] = {}


def _search(spark: SparkSession, d: str, query: str) -> DataFrame:
    """rowid_fts of the texts that a MATCH string finds; the token index of a folder is built once for each application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        path = work_dir(spark, "index")
        fulltext.build_index(t(spark, d, "messages_fts"), path)
        _INDEXES[at] = path
    return fulltext.search_index(spark, _INDEXES[at], query).withColumnRenamed("key", "rowid_fts")


def _any_field(term: str) -> str:
    return "(" + " OR ".join(f"contains({_WORDS.format(c=f)}, '{term}')" for f in archive.FIELDS) + ")"


@query(f"SELECT k.msg_id AS id, f.rowid_fts FROM messages_fts f JOIN fts_map k USING (rowid_fts) WHERE {_any_field(' perizia ')} AND {_any_field(' lunedi ')} AND NOT {_any_field(' fattura ')}")
def fts_match_all(spark: SparkSession, d: str) -> DataFrame:
    """Messages with two words, one of them with an accent, and without a third."""
    f = _search(spark, d, "perizia lunedì NOT fattura")
    return f.join(t(spark, d, "fts_map"), "rowid_fts").select(F.col("msg_id").alias("id"), "rowid_fts")


@query(f"SELECT rowid_fts FROM messages_fts WHERE contains({_WORDS.format(c='body')}, ' nulla osta ') OR {_any_field(' condomin')}")
def fts_phrase_prefix(spark: SparkSession, d: str) -> DataFrame:
    """A phrase in the body, or a word's beginning anywhere."""
    return _search(spark, d, 'body:"nulla osta" OR condomin*')


@query("""WITH words AS (SELECT DISTINCT rowid_fts, field, w FROM (SELECT rowid_fts, field, unnest(string_split_regex(""" + _FOLD.format(c="v") + """, '[^\\p{L}\\p{N}]+')) AS w FROM
  (SELECT rowid_fts, 'subject' AS field, subject AS v FROM messages_fts UNION ALL SELECT rowid_fts, 'sender', sender FROM messages_fts UNION ALL SELECT rowid_fts, 'recipients', recipients FROM messages_fts
   UNION ALL SELECT rowid_fts, 'body', body FROM messages_fts UNION ALL SELECT rowid_fts, 'attachments', attachments FROM messages_fts)) WHERE w <> '')
  SELECT w AS token, field, count(*) AS n FROM words GROUP BY ALL""")  # fmt: skip
def fts_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How many messages each word of the inverted index stands in."""
    return archive.token_index(t(spark, d, "messages_fts")).groupBy("token", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT msg_id, name, max(size) AS size, count(*) AS n_rows FROM attachments GROUP BY msg_id, name""")
def attachments_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row for each name of a message, and how many rows it had."""
    return t(spark, d, "attachments").groupBy("msg_id", "name").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT msg_id, list(name ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY has_text DESC, chars DESC, size DESC, name) AS rn FROM
  (SELECT DISTINCT msg_id, name, coalesce(size, 0) AS size, coalesce(chars, 0) AS chars, (coalesce(chars, 0) > 0)::INT AS has_text FROM attachments)) WHERE rn <= 3 GROUP BY msg_id""")
def attachment_interest_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three attachments of a message that say most: with text, longest text, largest."""
    a = t(spark, d, "attachments").select("msg_id", "name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("chars", F.lit(0)).alias("chars")).distinct()
    rank = F.struct(-(F.col("chars") > 0).cast("int"), -F.col("chars"), -F.col("size"), F.col("name"))
    return a.groupBy("msg_id").agg(F.array_sort(F.collect_list(rank)).alias("r")).select("msg_id", F.transform(F.slice("r", 1, 3), lambda x: x["name"]).alias("names"))


@query(f"""WITH {_NEWEST.format(cols='id, date_certified, date_sent, fetched_at, account')}, d AS (SELECT account, substr(coalesce(nullif(date_certified, ''), nullif(date_sent, ''), nullif(fetched_at, '')), 1, 10) AS giorno FROM newest)
  SELECT account, giorno, count(*) AS n FROM d GROUP BY ALL""")
def daily_window_index(spark: SparkSession, d: str) -> DataFrame:
    """Messages by mailbox and day of their best date."""
    return archive.with_day(_newest(spark, d, "id", "date_certified", "date_sent", "fetched_at", "account")).groupBy("account", "giorno").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NEWEST.format(cols='id, date_certified, date_sent, fetched_at')}, d AS (SELECT id, substr(coalesce(nullif(date_certified, ''), nullif(date_sent, ''), nullif(fetched_at, '')), 1, 10) AS giorno FROM newest)
  SELECT * FROM d WHERE giorno IN (SELECT DISTINCT giorno FROM d WHERE giorno IS NOT NULL ORDER BY giorno DESC LIMIT 7)""")
def last_n_days(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the last seven days that have any."""
    return archive.last_days(archive.with_day(_newest(spark, d, "id", "date_certified", "date_sent", "fetched_at")).select("id", "giorno"), 7)


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, account, client, msg_type, certified, date_certified, date_sent, from_addr, from_name, subject, message_id, receipt_kind, receipt_class, ref_message_id, mailbox_label, mailbox_address')}
  SELECT id, fetched_at AS acquisito_il, account AS casella_id, client AS casella_cliente, msg_type AS tipo, certified = 1 AS certificato, date_certified AS data_certificata, lower(from_addr) AS mittente_indirizzo,
  CASE WHEN from_addr IS NULL THEN NULL WHEN contains(from_addr, '@') THEN lower(string_split(from_addr, '@')[-1]) ELSE '' END AS mittente_dominio, receipt_kind AS ricevuta_tipo FROM newest""")
def index_record_struct(spark: SparkSession, d: str) -> DataFrame:
    """The compact record, its nested parts laid flat."""
    cols = ["id", "fetched_at", "account", "client", "msg_type", "certified", "date_certified", "date_sent", "from_addr", "from_name", "subject", "message_id", "receipt_kind", "receipt_class", "ref_message_id", "mailbox_label", "mailbox_address"]
    r = _newest(spark, d, *cols).select(*archive.index_record())
    return r.select("id", "acquisito_il", F.col("casella.id").alias("casella_id"), F.col("casella.cliente").alias("casella_cliente"), "tipo", "certificato", F.col("data.certificata").alias("data_certificata"),
                    F.col("mittente.indirizzo").alias("mittente_indirizzo"), F.col("mittente.dominio").alias("mittente_dominio"), F.col("ricevuta.tipo").alias("ricevuta_tipo"))


# ---- history ----------------------------------------------------------------------------------

_DATED = "id, account, lower(from_addr) AS sender, coalesce(date_certified, fetched_at) AS d"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    m = _newest(spark, d, "id", "account", "from_addr", "date_certified", "fetched_at")
    return m.select("id", "account", F.lower("from_addr").alias("sender"), archive.archive_date().alias("d")).where((F.col("sender") != "") & F.col("d").isNotNull())


@query(f"""WITH {_NEWEST.format(cols='id, account, from_addr, date_certified, fetched_at')}, m AS (SELECT {_DATED} FROM newest), x AS (SELECT * FROM m WHERE sender <> '' AND d IS NOT NULL)
  SELECT id, account, sender, d, rank() OVER (PARTITION BY account, sender ORDER BY d) - 1 AS seen_on_mailbox, rank() OVER (PARTITION BY sender ORDER BY d) - 1 AS seen_anywhere FROM x""")
def history_prior_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often a message's sender had written before, to its mailbox and to any."""
    one = history.prior_counts(_dated(spark, d), ["account", "sender"], "d", "seen_on_mailbox")
    return history.prior_counts(one, ["sender"], "d", "seen_anywhere").select("id", "account", "sender", "d", "seen_on_mailbox", "seen_anywhere")


_COVER = """cover AS (SELECT account, count(d) AS total, min(d) AS first_date, max(d) AS last_date,
  greatest(coalesce(CAST(floor((epoch(CAST(substr(max(d), 1, 19) AS TIMESTAMP)) - epoch(CAST(substr(min(d), 1, 19) AS TIMESTAMP))) / 86400) AS BIGINT), 0), 0) AS days FROM x GROUP BY account)"""


@query(f"WITH {_NEWEST.format(cols='id, account, from_addr, date_certified, fetched_at')}, x AS (SELECT {_DATED} FROM newest), {_COVER} SELECT *, total >= 20 AND days >= 90 AS sufficient FROM cover")
def mailbox_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How long and how well each mailbox is covered."""
    m = _newest(spark, d, "id", "account", "from_addr", "date_certified", "fetched_at")
    return history.coverage(m.select("account", archive.archive_date().alias("d")), "d")


@query(f"""WITH {_NEWEST.format(cols='id, account, from_addr, date_certified, fetched_at')}, x AS (SELECT {_DATED} FROM newest), {_COVER}, m AS (SELECT * FROM x WHERE sender <> '' AND d IS NOT NULL),
  h AS (SELECT id, account, rank() OVER (PARTITION BY account, sender ORDER BY d) - 1 AS a, rank() OVER (PARTITION BY sender ORDER BY d) - 1 AS b FROM m)
  SELECT h.id, coalesce(total >= 20 AND days >= 90, false) AND a = 0 AS mai_visto, coalesce(total >= 20 AND days >= 90, false) AND b = 0 AS sconosciuto, NOT coalesce(total >= 20 AND days >= 90, false) AND a = 0 AS storico_insufficiente
  FROM h LEFT JOIN cover USING (account)""")
def relational_signals(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sender is new, judged only where the mailbox has history enough."""
    h = history_prior_counts(spark, d)
    cover = mailbox_coverage(spark, d).select("account", "sufficient")
    enough = F.coalesce("sufficient", F.lit(False))
    j = h.join(cover, "account", "left")
    return j.select("id", (enough & (F.col("seen_on_mailbox") == 0)).alias("mai_visto"), (enough & (F.col("seen_anywhere") == 0)).alias("sconosciuto"), (~enough & (F.col("seen_on_mailbox") == 0)).alias("storico_insufficiente"))


# ---- ingestion --------------------------------------------------------------------------------

_CONCLUDED = "('done', 'skipped', 'duplicate')"


@query(f"SELECT account, uidvalidity, uid, status FROM mail_state a WHERE NOT EXISTS (SELECT 1 FROM mail_state s WHERE s.account = a.account AND s.uidvalidity = a.uidvalidity AND s.uid = a.uid AND s.status IN {_CONCLUDED})")
def filter_known_anti(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are not concluded yet."""
    s = t(spark, d, "mail_state").select("account", "uidvalidity", "uid", "status")
    return ingest.pending(s, s)


@query("""SELECT account, uidvalidity, uid, f.uidvalidity AS first_uidvalidity, f.uid AS first_uid, coalesce(f IS DISTINCT FROM struct_pack(uidvalidity := s.uidvalidity, uid := s.uid) AND f IS NOT NULL, false) AS duplicate
  FROM (SELECT *, CASE WHEN content_hash IS NOT NULL THEN min(struct_pack(uidvalidity := uidvalidity, uid := uid)) FILTER (WHERE status IN ('done', 'skipped')) OVER (PARTITION BY account, content_hash) END AS f FROM mail_state) s""")
def dedup_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Each row and the first row of the same content in its mailbox that was written or skipped."""
    s = t(spark, d, "mail_state").select("account", "uidvalidity", "uid", "content_hash", "status")
    return ingest.twins(s).select("account", "uidvalidity", "uid", "first_uidvalidity", "first_uid", "duplicate")


@query("SELECT account, uidvalidity, uid, substr(sha256(encode(account) || '\\x00'::BLOB || encode(content_hash)), 1, 24) AS key FROM mail_state")
def message_key(spark: SparkSession, d: str) -> DataFrame:
    """The identity that a mailbox and a content give."""
    return t(spark, d, "mail_state").select("account", "uidvalidity", "uid", ingest.message_key(F.col("account"), F.col("content_hash")).alias("key"))


@query("SELECT account, count(*) FILTER (WHERE size > 200000) AS oversize, count(*) FILTER (WHERE NOT coalesce(size > 200000, false)) AS kept, sum(size) AS bytes FROM mail_state GROUP BY account")
def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond and within a size limit by mailbox."""
    big = F.coalesce(F.col("size") > 200_000, F.lit(False))
    return t(spark, d, "mail_state").groupBy("account").agg(F.count_if(big).alias("oversize"), F.count_if(~big).alias("kept"), F.sum("size").alias("bytes"))


@query(f"SELECT account, uidvalidity, uid FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY uidvalidity, uid) AS rn FROM mail_state WHERE status NOT IN {_CONCLUDED}) WHERE rn <= 20")
def account_budget_rownum(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the next run takes: at most twenty of each mailbox (the run's budget)."""
    s = t(spark, d, "mail_state").where(~F.col("status").isin(*ingest.CONCLUDED)).select("account", "uidvalidity", "uid")
    return ingest.budget(s, 20)


@query(f"SELECT account, greatest(count(*) - 20, 0) AS remaining FROM mail_state WHERE status NOT IN {_CONCLUDED} GROUP BY account")
def remaining_per_account(spark: SparkSession, d: str) -> DataFrame:
    """What the budget leaves."""
    return ingest.remaining(t(spark, d, "mail_state").where(~F.col("status").isin(*ingest.CONCLUDED)), 20)


@query("SELECT account, uidvalidity, max(uid) AS last_uid, count(*) AS n FROM mail_state GROUP BY ALL")
def cursor_max(spark: SparkSession, d: str) -> DataFrame:
    """The highest uid of each mailbox epoch."""
    return ingest.cursors(t(spark, d, "mail_state"))


@query("""WITH c AS (SELECT account, uidvalidity AS epoch, last_uid FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY last_seen_at DESC NULLS LAST, folder) AS rn FROM mailboxes) WHERE rn = 1)
  SELECT s.account, s.uidvalidity, s.uid FROM mail_state s LEFT JOIN c USING (account) WHERE c.epoch IS NULL OR c.epoch <> s.uidvalidity OR s.uid > coalesce(c.last_uid, 0)""")
def beyond_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Rows after the mailbox's cursor, all of them where the epoch changed."""
    best = t(spark, d, "mailboxes").groupBy("account").agg(F.min_by(F.struct("uidvalidity", "last_uid"), F.struct(F.col("last_seen_at").isNull(), -F.unix_timestamp(F.try_to_timestamp("last_seen_at")), "folder")).alias("c"))
    return ingest.beyond(t(spark, d, "mail_state").select("account", "uidvalidity", "uid"), best.select("account", "c.*"))


@query("SELECT status, count(*) AS n, sum(attempts) AS attempts, count(error) AS errors FROM mail_state GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, attempts and errors by state."""
    return t(spark, d, "mail_state").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"), F.count("error").alias("errors"))


@query("""SELECT account, count(*) FILTER (WHERE files_done = 0) AS files, count(*) FILTER (WHERE files_done = 1 AND index_done = 0) AS "index", count(*) FILTER (WHERE index_done = 1 AND archive_done = 0) AS archive,
  count(*) FILTER (WHERE files_done = 1 AND index_done = 1 AND archive_done = 1) AS complete FROM mail_state GROUP BY account""")
def resume_phases(spark: SparkSession, d: str) -> DataFrame:
    """At which phase each mailbox's rows would be taken up again."""
    c = lambda n: F.col(f"{n}_done")
    return t(spark, d, "mail_state").groupBy("account").agg(F.count_if(c("files") == 0).alias("files"), F.count_if((c("files") == 1) & (c("index") == 0)).alias("index"), F.count_if((c("index") == 1) & (c("archive") == 0)).alias("archive"),
                                                           F.count_if((c("files") == 1) & (c("index") == 1) & (c("archive") == 1)).alias("complete"))


@query("""SELECT b.account, b.folder, coalesce(s.n, 0) AS n, coalesce(s.open, 0) AS open, CASE WHEN b.last_run_at IS NULL THEN 'mai' WHEN b.initialized = 0 THEN 'da inizializzare' ELSE 'ok' END AS state
  FROM mailboxes b LEFT JOIN (SELECT account, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('done', 'skipped', 'duplicate')) AS open FROM mail_state GROUP BY account) s USING (account)""")
def mailbox_status(spark: SparkSession, d: str) -> DataFrame:
    """Every mailbox folder with its rows and whether it was ever read."""
    s = t(spark, d, "mail_state").groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").isin(*ingest.CONCLUDED)).alias("open"))
    state = F.when(F.col("last_run_at").isNull(), "mai").when(F.col("initialized") == 0, "da inizializzare").otherwise("ok")
    return t(spark, d, "mailboxes").join(s, "account", "left").select("account", "folder", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"), state.alias("state"))


@query("""SELECT coalesce(s.msg_id, m.id) AS id, CASE WHEN m.id IS NOT NULL THEN 'done' ELSE s.status END AS status, s.msg_id IS NOT NULL AS known, m.id IS NOT NULL AS proven
  FROM (SELECT msg_id, min(status) AS status FROM mail_state WHERE msg_id IS NOT NULL GROUP BY msg_id) s FULL OUTER JOIN (SELECT DISTINCT id FROM messages) m ON s.msg_id = m.id""")
def reconcile_merge(spark: SparkSession, d: str) -> DataFrame:
    """The state merged with what the archive proves."""
    s = t(spark, d, "mail_state").where(F.col("msg_id").isNotNull()).groupBy(F.col("msg_id").alias("id")).agg(F.min("status").alias("status"))
    return ingest.reconcile(s, t(spark, d, "messages"))


# ---- receipts ---------------------------------------------------------------------------------


@query("SELECT msg_id, min(recorded_at) AS recorded_at, count(*) AS n FROM receipts WHERE msg_id IS NOT NULL GROUP BY msg_id")
def receipts_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each receipt; later ones change nothing."""
    r = t(spark, d, "receipts").where(F.col("msg_id").isNotNull()).select("msg_id", "recorded_at")
    return ingest.first_receipts(r, count="n")


@query("SELECT msg_type, CASE WHEN msg_type IN ('accettazione', 'presa_in_carico', 'avvenuta_consegna') THEN 'positiva' WHEN msg_type IN ('non_accettazione', 'errore_consegna', 'preavviso_errore_consegna', 'rilevazione_virus') THEN 'negativa' END AS class, count(DISTINCT id) AS n FROM messages GROUP BY msg_type")
def receipt_class(spark: SparkSession, d: str) -> DataFrame:
    """Message types by what they say about a delivery."""
    return t(spark, d, "messages").groupBy("msg_type").agg(F.countDistinct("id").alias("n")).withColumn("class", ingest.receipt_class(F.col("msg_type")))


@query("""SELECT r.msg_id, r.kind, m.id AS original FROM (SELECT DISTINCT msg_id, kind, ref_message_id FROM receipts) r LEFT JOIN (SELECT message_id, min(id) AS id FROM messages WHERE message_id IS NOT NULL GROUP BY message_id) m ON r.ref_message_id = m.message_id""")
def receipts_matched(spark: SparkSession, d: str) -> DataFrame:
    """Receipts and the message that they answer, null where it is not known."""
    m = t(spark, d, "messages").where(F.col("message_id").isNotNull()).groupBy(F.col("message_id").alias("ref_message_id")).agg(F.min("id").alias("original"))
    return t(spark, d, "receipts").select("msg_id", "kind", "ref_message_id").distinct().join(m, "ref_message_id", "left").select("msg_id", "kind", "original")


@query("SELECT DISTINCT msg_id, account, kind, coalesce(date_certified, recorded_at) AS d FROM receipts WHERE account = 'alba' ORDER BY d DESC NULLS LAST, msg_id, kind LIMIT 50")
def receipts_report(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest receipts of a mailbox."""
    r = t(spark, d, "receipts").where(F.col("account") == "alba").select("msg_id", "account", "kind", F.coalesce("date_certified", "recorded_at").alias("d")).distinct()
    return r.orderBy(F.col("d").desc_nulls_last(), "msg_id", "kind").limit(50)


# ---- functions over whole tables ---------------------------------------------------------------


@query("SELECT CASE WHEN from_addr IS NULL THEN NULL WHEN contains(from_addr, '@') THEN lower(string_split(from_addr, '@')[-1]) ELSE '' END AS domain, count(DISTINCT id) AS n FROM messages GROUP BY 1")
def domain_extract(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the domain of their sender."""
    return t(spark, d, "messages").groupBy(text.domain(F.col("from_addr")).alias("domain")).agg(F.countDistinct("id").alias("n"))


_EXTENSIONS = "list_transform(list_filter(string_split(string_split(replace(trim(coalesce(name, '')), chr(92), '/'), '/')[-1], '.')[2:], lambda p: p <> '' AND length(p) <= 12), lambda p: lower(trim(p)))"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"SELECT msg_id, name, {_EXTENSIONS} AS suffixes, list_has_any({_EXTENSIONS}, {_LIST(files.ACTIVE)}) AS active, coalesce({_EXTENSIONS}[-1], '') AS extension FROM (SELECT DISTINCT msg_id, name FROM attachments)")
def suffix_active_names(spark: SparkSession, d: str) -> DataFrame:
    """All endings of each attachment's name, and whether one of them runs."""
    a = t(spark, d, "attachments").select("msg_id", "name").distinct()
    return a.select("msg_id", "name", files.suffixes(F.col("name")).alias("suffixes"), files.active_name(F.col("name")).alias("active"), files.extension(F.col("name")).alias("extension"))


@query(f"""WITH e AS (SELECT *, {_EXTENSIONS} AS s, coalesce({_EXTENSIONS}[-1], '') AS ext FROM attachments)
  SELECT CASE WHEN ext IN ({_LIST(files.OPAQUE)[1:-1]}) THEN 'opaque' WHEN ext = 'zip' THEN 'zip' WHEN ext = 'tar' THEN 'tar' WHEN ext IN ('gz', 'tgz') THEN 'gz' WHEN ext IN ('bz2', 'tbz2', 'tb2') THEN 'bz2' WHEN ext IN ('xz', 'txz') THEN 'xz' ELSE '' END AS archive,
  list_has_any(s, {_LIST(files.ACTIVE)}) OR coalesce(lower(content_type) IN ({_LIST(files.EXECUTABLE_TYPES)[1:-1]}), false) AS active, count(*) AS n FROM e GROUP BY ALL""")
def file_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Attachments by archive kind and whether they would run, judged by name and type."""
    a = t(spark, d, "attachments")
    return a.groupBy(files.archive_kind(F.col("name")).alias("archive"), files.verdict(F.col("name"), F.col("content_type"))["active"].alias("active")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'\\r\\n?', E'\\n', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', ' ', 'g'),
  '[ \\t\\x{00A0}]+', ' ', 'g'), ' *\\n', E'\\n', 'g'), '\\n{3,}', E'\\n\\n', 'g'), '^[ \\n]+', ''), '[ \\n]+$', '') AS normal FROM documents""")
def normalize_text_cols(spark: SparkSession, d: str) -> DataFrame:
    """Every text with white space set in order."""
    return t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(password|passwd|pwd|token|secret|api[-_ ]?key|x-api-key)\b\s*[:=]\s*\S+', '\1=***', 'g'), '(?i)\b(LOGIN|AUTHENTICATE)\s+(\S+)\s+(\S+)', '\1 \2 ***', 'g'), 'sk-ant-[A-Za-z0-9_\-]{8,}', 'sk-ant-***', 'g') AS safe FROM documents""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Every text without passwords and keys."""
    return t(spark, d, "documents").select("doc_id", text.redact_secrets(F.col("text")).alias("safe"))


@query(r"""SELECT rowid_fts,
  regexp_matches(v, '(?i)(^|[^\p{L}\p{N}_])(sollecit[\p{L}\p{N}_]+|insolut[\p{L}\p{N}_]+|diffid[\p{L}\p{N}_]+|intimazion[\p{L}\p{N}_]+|morosit[\p{L}\p{N}_]+|mancato pagamento|pagamento non pervenuto|ultimo avviso)([^\p{L}\p{N}_]|$)') AS sollecito,
  regexp_matches(v, '(?i)(^|[^\p{L}\p{N}_])(urgent[\p{L}\p{N}_]+|immediat[\p{L}\p{N}_]+|entro (24|48) ore|improrogabil[\p{L}\p{N}_]+|tassativ[\p{L}\p{N}_]+|pena la sospensione)([^\p{L}\p{N}_]|$)') AS urgenza,
  regexp_matches(v, '(?i)(^|[^\p{L}\p{N}_])(iban|bonific[\p{L}\p{N}_]+|coordinate bancarie|nuove coordinate|conto corrente|swift|bic)([^\p{L}\p{N}_]|$)') AS pagamento FROM (SELECT rowid_fts, coalesce(subject, '') || chr(10) || coalesce(body, '') AS v FROM messages_fts)""")
def lexicon_flags(spark: SparkSession, d: str) -> DataFrame:
    """Reminders, urgency and payment words in subject and body."""
    v = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return t(spark, d, "messages_fts").select("rowid_fts", v.rlike(text.REMINDER).alias("sollecito"), v.rlike(text.URGENCY).alias("urgenza"), v.rlike(text.PAYMENT).alias("pagamento"))


@query(r"""SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])ignor[\p{L}\p{N}_]+\s+(le\s+)?(precedenti\s+)?istruzion') THEN 'ignora_istruzioni' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])ignore\s+(all\s+|the\s+)?(previous|prior|above)([^\p{L}\p{N}_]|$)') THEN 'ignore_previous' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])disregard\s+(all\s+|the\s+)?(previous|prior|above)([^\p{L}\p{N}_]|$)') THEN 'disregard' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(sei|agisci come)\s+un(''|\s+)?(assistente|intelligenza artificiale|modello linguistico)')
    OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])you\s+are\s+(an?\s+)?(ai\s+)?(assistant|language model)([^\p{L}\p{N}_]|$)') THEN 'ruolo_imposto' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(system|developer)\s+prompt([^\p{L}\p{N}_]|$)') THEN 'system_prompt' END,
  CASE WHEN regexp_matches(text, '(?i)</?\s*(materiale_non_fidato|system|istruzioni)([^\p{L}\p{N}_]|$)') THEN 'tag_falsificato' END,
  CASE WHEN regexp_matches(text, '(?im)^\s*(human|assistant|system)\s*:') THEN 'marcatore_di_turno' END,
  CASE WHEN regexp_matches(text, '(?im)^\s*(inoltra(re|lo|la)?|gira(re)?|spedisci|forward)\s+(quest[oa]|il|la|lo)?\s*(messaggio|documento|mail|email|allegato|pec)?\s*a\s+\S+@') THEN 'istruzione_di_inoltro' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])non\s+(mostrare|segnalare|riportare)\s+(questo|nulla)') THEN 'richiesta_di_silenzio' END], lambda x: x IS NOT NULL) AS hits FROM documents""")
def injection_hits(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that speak to a model instead of a reader."""
    return t(spark, d, "documents").select("doc_id", text.injection_hits(F.col("text")).alias("hits"))


@query("SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 3.6) AS INT) + 20 AS tokens, regexp_replace(text, '(?i)</?\\s*materiale_non_fidato[^>]*>', '[tag rimosso]', 'g') IS DISTINCT FROM text AS forged FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Rough token count of every text, and whether it forges a fence tag."""
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.token_estimate(c).alias("tokens"), (~text.neutralise_tags(c).eqNullSafe(c)).alias("forged"))


@query()
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Head and keyword windows of every text with what was left out."""
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", mime.excerpt(text.normalize(F.col("text")), ("scadenza", "entro", "euro", "diffida")).alias("e")).select("doc_id", "e.*")


@query("""SELECT doc_id, length(n) AS total FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'\\r\\n?', E'\\n', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', ' ', 'g'),
  '[ \\t\\x{00A0}]+', ' ', 'g'), ' *\\n', E'\\n', 'g'), '\\n{3,}', E'\\n\\n', 'g'), '^[ \\n]+', ''), '[ \\n]+$', '') AS n FROM documents)""")
def excerpt_totals(spark: SparkSession, d: str) -> DataFrame:
    """The lengths that the excerpts state."""
    return excerpts(spark, d).select("doc_id", "total")


@query("SELECT id, d, strftime((CAST(replace(d, 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS utc FROM (SELECT DISTINCT id, date_certified AS d FROM messages WHERE date_certified LIKE '____-__-__T__:__:__%')")
def instants(spark: SparkSession, d: str) -> DataFrame:
    """Certified dates of mixed offsets as instants."""
    m = t(spark, d, "messages").where(F.col("date_certified").like("____-__-__T__:__:__%")).select("id", F.col("date_certified").alias("d")).distinct()
    return m.select("id", "d", F.date_format(times.instant(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# ---- rules and register ------------------------------------------------------------------------

_RULES = [
    {"id": "r-bassa", "priorita": 10, "quando": {}},
    {"id": "r-dominio", "priorita": 100, "quando": {"mittente_dominio": ["corriera.example", "ombrosa.test"], "certificato": True}},
    {"id": "r-oggetto", "priorita": 90, "quando": {"oggetto_regex": ["(?i)sollecito", "(?i)scadenza"]}},
    {"id": "r-casella", "priorita": 80, "quando": {"casella": ["alba"], "ha_allegati": True}},
]


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, account, from_domain, certified, subject, n_attachments')}
  SELECT id, list_filter([CASE WHEN (lower(from_domain) IN ('corriera.example', 'ombrosa.test') OR lower(from_domain) LIKE '%.corriera.example' OR lower(from_domain) LIKE '%.ombrosa.test') AND certified = 1 THEN 'r-dominio' END,
  CASE WHEN regexp_matches(subject, '(?i)sollecito|scadenza') THEN 'r-oggetto' END, CASE WHEN account = 'alba' AND n_attachments > 0 THEN 'r-casella' END, 'r-bassa'], lambda x: x IS NOT NULL) AS rules FROM newest""")
def rules_matched(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the declared rules that each message meets, by priority."""
    m = _newest(spark, d, "id", "fetched_at", "account", "from_domain", "certified", "subject", "n_attachments")
    return m.select("id", rules.matched(_RULES).alias("rules"))


@query("""WITH o AS (SELECT e.extraction_id, coalesce(nullif(method, ''), '—') AS method, coalesce(nullif(CAST(is_ocr AS VARCHAR), ''), '—') AS is_ocr, coalesce(nullif(status, ''), '—') AS status, (c.extraction_id IS NOT NULL)::INT AS k
  FROM extractions e LEFT JOIN (SELECT DISTINCT extraction_id FROM extractions WHERE chars IS NULL OR chars = 0) c USING (extraction_id)),
  g AS (SELECT 'method' AS dimension, method AS value, k FROM o UNION ALL SELECT 'is_ocr', is_ocr, k FROM o UNION ALL SELECT 'status', status, k FROM o UNION ALL SELECT 'tutti', '', k FROM o)
  SELECT dimension, value, count(*) AS total, sum(k)::BIGINT AS corrected, round_even(sum(k) / count(*), 3) AS rate FROM g GROUP BY ALL""")
def register_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Extractions without text as corrections of their kinds, in one pass over grouping sets."""
    e = t(spark, d, "extractions").select("extraction_id", "method", "is_ocr", "status", "chars")
    empty = e.where(F.col("chars").isNull() | (F.col("chars") == 0))
    return register.register(e.drop("chars"), empty, ["method", "is_ocr", "status"], "extraction_id")


@query(f"WITH {_NEWEST.format(cols='id, fetched_at, from_addr')} SELECT lower(from_addr) AS sender, count(*) AS n FROM newest WHERE from_addr <> '' GROUP BY 1 ORDER BY n DESC, sender LIMIT 15")
def register_top_senders(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen busiest senders."""
    m = _newest(spark, d, "id", "fetched_at", "from_addr").where(F.col("from_addr") != "")
    return m.groupBy(F.lower("from_addr").alias("sender")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sender").limit(15)


@query("SELECT o.msg_id, o.name, c.msg_id IS NOT NULL AS corrected FROM (SELECT DISTINCT msg_id, name FROM attachments) o LEFT JOIN (SELECT DISTINCT msg_id FROM extractions WHERE status <> 'ok') c USING (msg_id)")
def corrections_semi(spark: SparkSession, d: str) -> DataFrame:
    """Existence join: attachments of messages with a failed extraction."""
    c = t(spark, d, "extractions").where(F.col("status") != "ok").select("msg_id").distinct().withColumn("_c", F.lit(True))
    return t(spark, d, "attachments").select("msg_id", "name").distinct().join(c, "msg_id", "left").select("msg_id", "name", F.coalesce("_c", F.lit(False)).alias("corrected"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed, sum(chars)::BIGINT AS chars, count(*) FILTER (WHERE truncated) AS truncated FROM extractions")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a run over all extractions."""
    return t(spark, d, "extractions").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("chars").alias("chars"), F.count_if("truncated").alias("truncated"))


# ---- streaming ---------------------------------------------------------------------------------


@query("SELECT DISTINCT account, content_hash, msg_id FROM mail_state")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The state table read as a stream, each content of a mailbox once; all there is now, then stop."""
    import os

    from postmill.session import work_dir
    from postmill.streaming.ingest import unique

    base = work_dir(spark, "stream")
    path = f"{d}/mail_state.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    local = path.removeprefix("file://")
    if "://" not in local and os.path.isfile(local):  # a stream reads folders: take the one file of this name
        folder, name = os.path.split(path)
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    q = unique(stream.select("account", "content_hash", "msg_id")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("account", "content_hash", "msg_id")


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, account, client, mailbox_label, mailbox_address, date_certified, date_sent')}
  SELECT id, coalesce(nullif(client, ''), account) AS client, coalesce(nullif(mailbox_label, ''), nullif(mailbox_address, ''), account) AS label, coalesce(nullif(date_certified, ''), nullif(date_sent, ''), nullif(fetched_at, '')) AS date FROM newest""")
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    """Client, mailbox label and date of each message, each from the first source that says it."""
    m = _newest(spark, d, "id", "fetched_at", "account", "client", "mailbox_label", "mailbox_address", "date_certified", "date_sent")
    c = F.col
    return m.select("id", F.coalesce(text.first_of(c("client")), c("account")).alias("client"), F.coalesce(text.first_of(c("mailbox_label"), c("mailbox_address")), c("account")).alias("label"), times.best_date(c("date_certified"), c("date_sent"), c("fetched_at")).alias("date"))


@query(f"""WITH {_NEWEST.format(cols='id, fetched_at, account, subject, date_certified')}, s AS (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace({_FOLD.format(c='subject')}, '[^a-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 44) AS slug FROM newest)
  SELECT id, CASE WHEN date_certified LIKE '____-__-__T__:__:__%' THEN strftime(CAST(replace(date_certified, 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'Europe/Rome', '%Y%m%d-%H%M') ELSE 'senza-data' END || '_' || substr(lower(account), 1, 32) || '_' || CASE WHEN slug <> '' THEN slug ELSE 'senza-oggetto' END || '_' || substr(id, 1, 12) AS folder FROM s""")
def message_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folder name under which each message is written."""
    from postmill.functions import naming

    m = _newest(spark, d, "id", "fetched_at", "account", "subject", "date_certified")
    return m.select("id", naming.folder(F.col("account"), F.col("subject"), F.col("date_certified"), F.col("id")).alias("folder"))


@query(r"""WITH a AS (SELECT msg_id, list_sort(list(name) FILTER (WHERE name IS NOT NULL)) AS names FROM attachments GROUP BY msg_id), u AS (SELECT msg_id, unnest(names) AS name, unnest(range(len(names))) AS i FROM a),
  c AS (SELECT *, rtrim(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(name), '[\t\r\n]', ' ', 'g'), '[\x00-\x1f\x7f<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g')), '. ') AS clean FROM u),
  p AS (SELECT *, trim(clean, '.') = '' AS nothing, length(string_split(clean, '.')[-1]) <= 12 AND instr(clean, '.') > 1 AND length(regexp_extract(clean, '^(.*)\.[^.]*$', 1)) > 0 AS cut FROM c),
  q AS (SELECT *, CASE WHEN cut THEN regexp_extract(clean, '^(.*)\.[^.]*$', 1) ELSE clean END AS stem, CASE WHEN cut THEN '.' || replace(string_split(clean, '.')[-1], ' ', '') ELSE '' END AS tail, CASE WHEN cut THEN 1 + length(string_split(clean, '.')[-1]) ELSE 0 END AS room FROM p),
  b AS (SELECT *, CASE WHEN nothing THEN 'allegato' ELSE rtrim(substr(CASE WHEN regexp_matches(lower(stem), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || stem ELSE stem END, 1, 96 - room), '. ') || tail END AS base FROM q),
  n AS (SELECT *, row_number() OVER (PARTITION BY msg_id, lower(base) ORDER BY i) - 1 AS k FROM b),
  f AS (SELECT *, CASE WHEN k = 0 THEN base WHEN contains(base, '.') THEN substr(regexp_extract(base, '^(.*)\.[^.]*$', 1), 1, 96 - length('-' || k || '.' || string_split(base, '.')[-1])) || '-' || k || '.' || string_split(base, '.')[-1] ELSE substr(base, 1, 96 - length('-' || k)) || '-' || k END AS file FROM n)
  SELECT msg_id, list(name ORDER BY i) AS names, list(file ORDER BY i) AS files FROM f GROUP BY msg_id""")
def attachment_safe_names(spark: SparkSession, d: str) -> DataFrame:
    """The names under which each message's attachments are written, harmless and unique."""
    from postmill.functions import naming

    a = t(spark, d, "attachments").groupBy("msg_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return a.select("msg_id", "names", naming.unique_names("names").alias("files"))


@query("SELECT m.id, r.n AS receipts, m.d FROM (SELECT id, min(coalesce(date_certified, fetched_at)) AS d, min(message_id) AS message_id FROM messages GROUP BY id) m JOIN (SELECT ref_message_id, count(DISTINCT msg_id) AS n FROM receipts WHERE ref_message_id IS NOT NULL GROUP BY 1) r ON r.ref_message_id = m.message_id")
def receipts_per_message(spark: SparkSession, d: str) -> DataFrame:
    """How many positive receipts answer each message."""
    m = t(spark, d, "messages").groupBy("id").agg(F.min(archive.archive_date()).alias("d"), F.min("message_id").alias("ref_message_id"))
    r = t(spark, d, "receipts").where(F.col("ref_message_id").isNotNull()).groupBy("ref_message_id").agg(F.countDistinct("msg_id").alias("receipts"))
    return m.join(r, "ref_message_id").select("id", "receipts", "d")


@query("SELECT m.id, s.status, s.attempts FROM (SELECT DISTINCT id FROM messages) m JOIN (SELECT msg_id, max(status) AS status, sum(attempts) AS attempts FROM mail_state WHERE attempts > 3 OR error IS NOT NULL GROUP BY msg_id) s ON s.msg_id = m.id")
def troubled_messages(spark: SparkSession, d: str) -> DataFrame:
    """Archived messages whose ingestion failed or was tried too often."""
    s = t(spark, d, "mail_state").where((F.col("attempts") > 3) | F.col("error").isNotNull()).groupBy(F.col("msg_id").alias("id")).agg(F.max("status").alias("status"), F.sum("attempts").alias("attempts"))
    return t(spark, d, "messages").select("id").distinct().join(s, "id")

