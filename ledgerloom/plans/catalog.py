"""Every query of the package by name; each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import dates, language, scores, text
from ledgerloom.operators import analytics, duplicates, entities, export, extract, languages, pages, phrases, search, upsert, validate, views
from ledgerloom.plans import jobs
from ledgerloom.session import inline_table, stage, stage_path, work_dir
from ledgerloom.sources import ledger, recognised, requests
from ledgerloom.sources.invoices import cents_text, invoice_facts, invoice_text
from ledgerloom.sources.tables import table
from ledgerloom.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Registers a function under its own name."""
    _QUERIES[run.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(column: str) -> Column:
    return F.array_join(column, "; ").alias(column)


# --- sources -----------------------------------------------------------------

@query
def supported_file_filter(spark, folder):
    facts = invoice_facts(spark, folder)
    name = F.col("filename")
    return facts.select("key", "filename", text.file_extension(name).alias("extension"),
                        text.is_supported_file(name).alias("supported"))


@query
def content_hash(spark, folder):
    body = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", text.content_hash(body).alias("sha256"), text.content_hash(body, "sha1").alias("sha1"),
        text.content_hash(body, "md5").alias("md5"))


@query
def list_recent(spark, folder):
    return views.record_view(views.newest_first(ledger.records(spark, folder), fixed.RECENT_ROWS))


@query
def render_invoice_text(spark, folder):
    return invoice_text(spark, folder).select(
        "doc_id", "filename", "file_hash", "text", views.time_text(F.col("received_at")).alias("received_at"))


# --- pages and documents -----------------------------------------------------

def _first_engine(spark, folder):
    return pages.page_text(recognised.recognised_pages(spark, folder)).drop("words", "role")


def _second_engine(spark, folder):
    return pages.page_text_alt(recognised.recognised_pages_alt(spark, folder)).drop("words", "role")


@query
def page_text(spark, folder):
    return _first_engine(spark, folder).withColumn("conf", analytics.rounded(F.col("conf"), 6))


@query
def page_text_alt(spark, folder):
    return _second_engine(spark, folder).withColumn("conf", analytics.rounded(F.col("conf"), 6))


def _chosen(spark, folder):
    return pages.choose_engine(_first_engine(spark, folder), _second_engine(spark, folder))


@query
def ocr_fallback(spark, folder):
    return _chosen(spark, folder).withColumn("conf", analytics.rounded(F.col("conf"), 6))


@query
def assemble_documents(spark, folder):
    return pages.assemble_documents(_chosen(spark, folder))


# --- text, number and date functions -----------------------------------------

@query
def normalize_whitespace(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.squeeze(F.col("text")).alias("text"))


@query
def clean_text(spark, folder):
    """Letters and digits of the texts are widened first; cleaning has to bring them back."""
    plain = "".join(map(chr, range(0x21, 0x7F)))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    return table(spark, folder, "documents").select(
        "doc_id", text.clean_text(F.translate("text", plain, wide)).alias("text"))


@query
def strip_control(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.strip_control(F.col("text")).alias("text"))


def _raw_amounts(spark, folder):
    """The subtotal of every invoice in six ways of writing."""
    plain = cents_text(F.col("subtotal_c"), F.lit(""))
    way = F.col("key") % 6
    raw = (
        F.when(way == 0, cents_text(F.col("subtotal_c"), F.col("sym")))
        .when(way == 1, F.translate(plain, ",.", ".,"))
        .when(way == 2, F.translate(plain, ",", ""))
        .when(way == 3, F.concat(F.lit("  "), F.translate(plain, ",", " "), F.lit("  ")))
        .when(way == 4, F.translate(plain, fixed.ASCII_DIGITS[:10], fixed.FOREIGN_DIGITS[:10]))
        .otherwise(F.when(F.col("key") % 12 == 5, "").otherwise("5-3"))
    )
    return invoice_facts(spark, folder).select("key", raw.alias("raw"))


@query
def parse_amount(spark, folder):
    return _raw_amounts(spark, folder).withColumn("amount", text.parse_amount(F.col("raw")))


@query
def parse_int(spark, folder):
    return _raw_amounts(spark, folder).withColumn("number", text.parse_int(F.col("raw")))


def _raw_dates(spark, folder):
    """The invoice day of every invoice in fourteen shapes, one of them no date."""
    shapes = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy",
              "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "dd MMM yyyy", "yyyyMMdd", "dd/MM/yy"]
    raw = F.lit("no date")
    for i, shape in enumerate(shapes):
        raw = F.when(F.col("key") % 14 == i, F.date_format("invoice_day", shape)).otherwise(raw)
    return invoice_facts(spark, folder).select("key", raw.alias("raw"))


@query
def parse_date(spark, folder):
    return _raw_dates(spark, folder).withColumn("day", F.date_format(dates.parse_date(F.col("raw")), "yyyy-MM-dd"))


@query
def format_date_iso(spark, folder):
    return _raw_dates(spark, folder).withColumn("iso", dates.format_date_iso(F.col("raw")))


@query
def confidence_labels(spark, folder):
    rows = ledger.scored(ledger.known_fields(spark, folder))
    rows = rows.select("id", F.explode("confidence_scores").alias("field", "score"))
    return rows.withColumn("label", scores.confidence_label(F.col("score")))


@query
def confidence_badges(spark, folder):
    rows = ledger.scored(ledger.known_fields(spark, folder))
    score = F.when(F.col("key") % 10 != 3, F.col("ocr_confidence"))
    percent = scores.bar_percent(score)
    return rows.select("id", score.alias("score"), scores.confidence_badge(score).alias("badge"),
                       percent.alias("percent"), scores.bar_colour(percent).alias("colour"))


@query
def report_json(spark, folder):
    return ledger.validated(spark, folder).select(
        "id", F.to_json(validate.report()).alias("report"), F.to_json("confidence_scores").alias("scores"))


# --- extraction --------------------------------------------------------------

@query
def first_match(spark, folder):
    return invoice_text(spark, folder).select(
        "doc_id", text.first_match(text.line_text(F.col("text")), fixed.NUMBER_PATTERNS).alias("hit"))


@query
def all_matches(spark, folder):
    found = text.all_matches(F.col("lines"), [*fixed.CURRENCY_PATTERNS, *fixed.DUE_PATTERNS])
    docs = invoice_text(spark, folder).select("doc_id", text.line_text(F.col("text")).alias("lines"))
    return docs.select("doc_id", F.array_join(found, "|").alias("hits"))


def _extracted(*columns: str) -> Query:
    return lambda spark, folder: extract.extract_columns(invoice_text(spark, folder)).select("doc_id", *columns)


for _name, _columns in {
    "extract_invoice_number": ["invoice_number", "score_invoice_number"],
    "extract_invoice_date": ["invoice_date", "score_invoice_date"],
    "extract_due_date": ["due_date", "score_due_date"],
    "extract_total": ["total_amount", "score_total_amount"],
    "extract_subtotal": ["subtotal", "score_subtotal"],
    "extract_tax": ["tax_amount", "tax_rate", "score_tax_amount"],
    "extract_discount": ["discount"],
    "extract_parties": ["vendor_name", "buyer_name", "score_vendor_name", "score_buyer_name"],
    "extract_tax_id": ["tax_id", "score_tax_id"],
    "extract_po_number": ["po_number", "score_po_number"],
    "extract_address": ["address", "score_address"],
    "extract_currency": ["currency", "score_currency"],
    "extract_payment_terms": ["payment_terms", "score_payment_terms"],
}.items():
    _QUERIES[_name] = _extracted(*_columns)


@query
def extract_parties_by_entities(spark, folder):
    """Parties of texts whose party labels are taken out, by the names of all suppliers and customers."""
    def named(name: str, word: str, key: str) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.select(F.concat_ws(" ", F.lit(word), F.col(key)).alias("name"), F.lit("ORG").alias("label"))

    names = named("supplier", "vendor", "s_suppkey").unionByName(named("customer", "buyer", "c_custkey"))
    plain = F.regexp_replace("text", r"(?m)^(From|Bill To): ", "")
    docs = invoice_text(spark, folder).select("doc_id", plain.alias("text"))
    return extract.extract_columns(entities.find_known_names(docs, names)).select(
        "doc_id", "vendor_name", "buyer_name", "score_vendor_name", "score_buyer_name")


@query
def extract_fields(spark, folder):
    fields = extract.extract_fields(invoice_text(spark, folder))
    return fields.select("doc_id", *fixed.FIELD_COLUMNS, F.to_json("confidence_scores").alias("scores"),
                         "avg_field_confidence")


@query
def extraction_accuracy(spark, folder):
    """Fields read from the rendered texts next to the facts they were rendered from."""
    def as_struct(rows: DataFrame, key: str, name: str) -> DataFrame:
        values = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fixed.CHECKED_FIELDS]
        return rows.select(F.col(key).alias("id"), F.struct(*values).alias(name))

    read = as_struct(extract.extract_columns(invoice_text(spark, folder)), "doc_id", "got")
    facts = as_struct(ledger.known_fields(spark, folder), "id", "want")
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"want.{f}").alias("want"), F.col(f"got.{f}").alias("got"))
             for f in fixed.CHECKED_FIELDS]
    both = facts.join(read, "id", "left").select("id", F.inline(F.array(*pairs)))
    return both.groupBy("field", F.pmod(F.col("id") - 1, F.lit(7)).alias("template")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("want")).alias("n_right"))


# --- language ----------------------------------------------------------------

@query
def document_languages(spark, folder):
    docs = table(spark, folder, "documents")
    return languages.detect_languages(docs, languages.learn_languages(docs), ["doc_id"])


@query
def detect_language(spark, folder):
    docs = invoice_text(spark, folder).select("doc_id", "text")
    return language.with_language(docs).drop("text")


@query
def detect_script(spark, folder):
    docs = language.with_script(invoice_text(spark, folder).select("doc_id", "text"), "text", "script")
    return docs.select("doc_id", F.coalesce(F.nullif("script", F.lit("")), F.lit("en")).alias("lang_code"))


def _profiles(spark, folder):
    docs = table(spark, folder, "documents")
    scored = languages.score_languages(docs, languages.learn_languages(docs), ["doc_id", "lang"], F.col("text"))
    return scored.select("doc_id", "lang", F.coalesce("best.lang", F.lit("")).alias("detected"), F.col("best.score").alias("score"), "n_grams")


@query
def language_profile(spark, folder):
    return _profiles(spark, folder)


@query
def language_accuracy(spark, folder):
    """Labels and detected languages of the texts that the model hasn't learned from."""
    rows = _profiles(spark, folder).where(languages.held_out(F.col("doc_id")))
    return rows.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query
def language_names(spark, folder):
    names = inline_table(spark, "code string, name string", list(fixed.LANGUAGE_NAMES.items()))
    code = F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang"))
    docs = table(spark, folder, "documents").select("doc_id", code.alias("code"))
    shown = F.coalesce("name", F.concat(F.lit("Unknown ("), F.col("code"), F.lit(")")))
    return docs.join(F.broadcast(names), "code", "left").select("doc_id", "code", shown.alias("name"))


# --- validation --------------------------------------------------------------

def _checked(rules: Callable[[], validate.Rules], *kinds: str) -> Query:
    def run(spark, folder):
        rows = validate.apply_rules(validate.with_days(ledger.known_fields(spark, folder)), rules())
        return rows.select("id", *[_joined(k) for k in kinds])

    return run


_ALL_KINDS = (validate.PASSED, validate.WARNING, validate.ERROR)
_QUERIES["check_mandatory"] = _checked(validate.mandatory_rules, *_ALL_KINDS)
_QUERIES["check_invoice_number"] = _checked(validate.number_rules, *_ALL_KINDS)
_QUERIES["check_dates"] = _checked(lambda: validate.date_rules(fixed.AS_OF), *_ALL_KINDS)
_QUERIES["check_amounts"] = _checked(validate.amount_rules, *_ALL_KINDS)
_QUERIES["check_currency"] = _checked(validate.currency_rules, *_ALL_KINDS)
_QUERIES["check_strict"] = _checked(validate.strict_rules, validate.WARNING)


@query
def validate_invoices(spark, folder):
    return ledger.validated(spark, folder).select(
        "id", "validation_status", *[_joined(k) for k in _ALL_KINDS], "is_duplicate")


@query
def validation_counts(spark, folder):
    return ledger.validated(spark, folder).select(
        "id", "validation_status", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in _ALL_KINDS])


@query
def flag_duplicates(spark, folder):
    rows = duplicates.flag_duplicates(ledger.known_fields(spark, folder))
    return rows.select("id", "invoice_number", "is_duplicate", "duplicate_of")


@query
def duplicates_vs_history(spark, folder):
    rows = ledger.known_fields(spark, folder).select("id", "key", "invoice_number")
    found = duplicates.duplicates_vs_history(rows.where("key % 10 = 0"), rows.where("key % 10 <> 0"))
    return found.select("id", "invoice_number", "duplicate_of")


# --- table views -------------------------------------------------------------

@query
def invoice_records(spark, folder):
    return views.record_view(ledger.records(spark, folder))


@query
def export_projection(spark, folder):
    """po_number is taken out first: an absent column comes back as NULL."""
    return views.export_view(ledger.records(spark, folder).drop("po_number")).withColumns(
        {c: F.col(c).cast("double") for c in fixed.MONEY_COLUMNS})


@query
def invoice_by_id(spark, folder):
    """The invoice of the highest order key that has one."""
    rows = ledger.records(spark, folder)
    top = table(spark, folder, "lineitem").agg(F.max("l_orderkey") + 1)
    return views.record_view(rows.where(F.col("id") == top.scalar()))


@query
def batch_result_view(spark, folder):
    return views.batch_view(_processed(spark, folder))


@query
def results_view(spark, folder):
    return views.results_view(ledger.records(spark, folder))


@query
def failed_invoices(spark, folder):
    return views.with_status(ledger.records(spark, folder), "FAILED")


@query
def warning_invoices(spark, folder):
    return views.with_status(ledger.records(spark, folder), "WARNING")


@query
def passed_invoices(spark, folder):
    return views.with_status(ledger.records(spark, folder), "PASSED")


@query
def duplicate_invoices(spark, folder):
    return views.duplicates_view(ledger.records(spark, folder))


# --- aggregates --------------------------------------------------------------

@query
def by_language(spark, folder):
    return analytics.count_by(ledger.known_fields(spark, folder), "detected_language")


@query
def by_validation_status(spark, folder):
    return analytics.count_by(ledger.records(spark, folder), "validation_status")


@query
def totals_by_currency(spark, folder):
    return analytics.totals_by_currency(ledger.known_fields(spark, folder))


@query
def analytics_summary(spark, folder):
    row = analytics.summary(ledger.records(spark, folder))
    return row.withColumns({c: analytics.map_text(F.col(c)) for c in ("by_language", "by_validation_status")})


@query
def status_summary(spark, folder):
    return analytics.status_summary(ledger.records(spark, folder))


@query
def avg_confidence(spark, folder):
    return ledger.scored(ledger.known_fields(spark, folder)).select("id", "avg_field_confidence")


@query
def batch_summary(spark, folder):
    # as in quarantine: success doesn't depend on duplicates
    return analytics.batch_summary(_processed(spark, folder, flag=False).select("success"))


@query
def latency_stats(spark, folder):
    return analytics.latency_stats(table(spark, folder, "events"), "view", "event_type", "value")


@query
def validation_errors(spark, folder):
    return analytics.error_messages(ledger.records(spark, folder))


@query
def error_frequency(spark, folder):
    return analytics.error_frequency(ledger.records(spark, folder))


@query
def language_distribution(spark, folder):
    counts = analytics.count_by(ledger.known_fields(spark, folder), "detected_language")
    return counts.orderBy(F.desc("n"), "detected_language")


@query
def export_preview(spark, folder):
    newest = views.newest_first(ledger.records(spark, folder), fixed.PREVIEW_ROWS)
    return views.export_view(newest).withColumns({c: F.col(c).cast("double") for c in fixed.MONEY_COLUMNS})


# --- search ------------------------------------------------------------------

@query
def search_facets(spark, folder):
    wanted = search.Request(currency="EUR", language="de", validation_status="PASSED")
    return search.facet_filter(ledger.records(spark, folder), wanted).select(*search.HIT_COLUMNS)


@query
def search_amount_range(spark, folder):
    wanted = search.Request(min_amount=50000.0, max_amount=100000.0)
    return search.facet_filter(ledger.records(spark, folder), wanted).select(*search.HIT_COLUMNS)


@query
def search_keyword_scan(spark, folder):
    rows = search.scan_filter(ledger.invoices(spark, folder), search.Request(q="Part 17", vendor="lantern"))
    return rows.select(*search.HIT_COLUMNS)


@query
def search_scan(spark, folder):
    wanted = search.Request(q="GmbH", currency="EUR", min_amount=100000.0, limit=100)
    return search.scan_search(ledger.invoices(spark, folder), wanted)


@query
def vendor_scan_batch(spark, folder):
    return search.vendor_scan_batch(requests.vendor_queries(spark, folder), ledger.known_fields(spark, folder))


def _document_rows(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))


@query
def tokenize(spark, folder):
    rows = _document_rows(spark, folder)
    rows = rows.select(F.col("id").alias("doc_id"), F.posexplode(search.index_tokens(F.col("raw_text"))).alias("pos", "word"))
    return search.with_terms(rows).withColumnRenamed("word", "token")


@query
def build_postings(spark, folder):
    return search.build_postings(_document_rows(spark, folder), ["raw_text"])


@query
def update_postings(spark, folder):
    rows = _document_rows(spark, folder)
    changed = rows.where("id % 10 = 0").withColumn("raw_text", F.concat("raw_text", F.lit(" revised editions")))
    return search.update_postings(search.build_postings(rows, ["raw_text"]), changed, fields=["raw_text"])


def _invoice_postings(spark, folder):
    texts = invoice_text(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))
    names = ledger.known_fields(spark, folder).select("id", "vendor_name", "buyer_name", "invoice_number")
    return stage(search.build_postings(names.join(texts, "id")), "postings")


def _hits(spark, folder):
    wanted = requests.mixed_queries(spark, folder)
    postings = _invoice_postings(spark, folder)
    rows = stage(ledger.records(spark, folder).select(*search.HIT_COLUMNS), "records")
    return search.apply_facets(search.match(wanted, postings), wanted, rows), postings, rows


@query
def fulltext_match(spark, folder):
    hits, _, _ = _hits(spark, folder)
    return hits.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query
def bm25_scores(spark, folder):
    hits, postings, rows = _hits(spark, folder)
    return search.score(hits, search.field_stats(rows.select("id"), postings))


@query
def search_topk(spark, folder):
    rows = stage(ledger.records(spark, folder).select(*search.HIT_COLUMNS), "records")
    return search.search_batch(requests.mixed_queries(spark, folder), rows, _invoice_postings(spark, folder), 10)


@query
def vendor_search_batch(spark, folder):
    rows = stage(ledger.records(spark, folder).select(*search.HIT_COLUMNS), "records")
    postings = stage(search.build_postings(rows, ["vendor_name"]), "postings")
    return search.search_batch(requests.vendor_queries(spark, folder), rows, postings, fixed.BATCH_SEARCH_LIMIT)


@query
def word_requests(spark, folder):
    """Phrases, beginnings and sets of words taken from the benchmark items, over the documents' texts."""
    rows = _document_rows(spark, folder)
    postings = stage(phrases.positional_postings(rows, "raw_text"), "places")
    return phrases.answer_requests(requests.word_requests(spark, folder), postings)


# --- merge and sinks ---------------------------------------------------------

def _merge_sides(spark, folder):
    rows = ledger.records(spark, folder).select("id", "filename", "invoice_number", "total_amount", "validation_status",
                                                "processed_at")
    hashes = invoice_text(spark, folder).select(F.col("doc_id").alias("id"), "key", "file_hash")
    rows = stage(rows.join(hashes, "id"), "stored")
    target = rows.where("key % 4 <> 0").drop("key")
    first = rows.where("key % 4 = 0").withColumn("ingest_seq", F.lit(1))
    again = rows.where("key % 10 = 0").withColumns({
        "validation_status": F.lit("RECHECK"), "total_amount": F.lit(None).cast("double"), "ingest_seq": F.lit(2)})
    return target, first.unionByName(again).drop("id", "key", "processed_at")


@query
def upsert_by_hash(spark, folder):
    target, incoming = _merge_sides(spark, folder)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    merged = upsert.upsert_by_hash(target, incoming, now)
    return merged.withColumn("processed_at", views.time_text(F.col("processed_at")))


def _export_schema(rows: DataFrame) -> str:
    flags = {"is_duplicate": "string"}
    return ", ".join(f"`{n}` {flags.get(n, t)}" for n, t in views.export_view(rows).dtypes)


@query
def export_csv(spark, folder):
    rows = ledger.records(spark, folder)
    path = export.export_csv(rows, work_dir(spark, "export"))
    back = export.read_csv_export(spark, path, _export_schema(rows))
    return back.withColumns({c: F.col(c).cast("double") for c in fixed.MONEY_COLUMNS})


@query
def export_json(spark, folder):
    rows = ledger.records(spark, folder)
    path = export.export_json(rows, work_dir(spark, "export"))
    back = spark.read.schema(views.export_view(rows).schema).json(path)
    return back.withColumns({c: F.col(c).cast("double") for c in fixed.MONEY_COLUMNS})


@query
def export_both(spark, folder):
    """Row count and sum of ids of the two exports of one call; their parts are compressed, as names of JSON fields come on each line."""
    rows = stage(ledger.records(spark, folder).select(*fixed.RECORD_COLUMNS), "records")
    paths = export.export(rows, work_dir(spark, "export"), "both", None, "gzip")
    csv = export.read_csv_export(spark, paths["csv"], _export_schema(rows)).select(F.lit("csv").alias("format"), "id")
    json = spark.read.schema(views.export_view(rows).schema).json(paths["json"]).select(F.lit("json").alias("format"), "id")
    return csv.unionByName(json).groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


# --- jobs and streams --------------------------------------------------------

def _processed(spark, folder, flag=True):
    docs = invoice_text(spark, folder).withColumns({
        "ocr_engine": F.when(F.col("key") % 5 == 0, "easyocr").otherwise("tesseract"),
        "ocr_confidence": (F.pmod("key", F.lit(41)) + 60) / 100,
    }).drop("key")
    return jobs.process_documents(docs, flag=flag)


@query
def process_documents(spark, folder):
    return _processed(spark, folder).select(
        "doc_id", "filename", "file_hash", "success", "error", "ocr_engine", "ocr_confidence", *fixed.FIELD_COLUMNS,
        "avg_field_confidence", "validation_status", "is_duplicate", F.to_json("validation_report").alias("report"))


@query
def quarantine(spark, folder):
    # failures don't depend on duplicates; without them nothing is written and Spark leaves out what isn't asked for
    return jobs.quarantine(_processed(spark, folder, flag=False))


def _intake(spark, folder):
    """Every invoice once, and those of every tenth key once more under another name."""
    docs = invoice_text(spark, folder).withColumn("ingest_seq", F.lit(1))
    again = docs.where("key % 10 = 0").withColumns({
        "filename": F.concat(F.lit("again_"), F.regexp_replace("filename", r"\.[a-z]+\z", ".pdf")),
        "ingest_seq": F.lit(2), "received_at": F.col("received_at") + F.expr("INTERVAL 1 DAY")})
    return docs.unionByName(again).drop("key")


@query
def stream_intake(spark, folder):
    """Three deliveries, each merged by a run of its own; the fourth run finds nothing new."""
    inbox = stage(_intake(spark, folder), "intake")
    path, root, progress = (work_dir(spark, name) for name in ("inbox", "store", "progress"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    for part in ("ingest_seq = 1 AND doc_id % 2 = 0", "ingest_seq = 1 AND doc_id % 2 = 1", "ingest_seq = 2", None):
        if part:
            inbox.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(inbox.schema).parquet(path)
        intake.start_intake(stream, root, progress, now).awaitTermination()
    return intake.current_records(spark, root).select("file_hash", "filename", "invoice_number", "total_amount", "validation_status", "is_duplicate")


@query
def stream_dedup(spark, folder):
    """Every text once; copies within the delay are dropped, copies after it are new.

    Texts arrive in January, copies of every tenth five days later. Deliveries of May move the watermark on and are
    themselves copies to drop; copies of another tenth that come after that find no state.
    """
    texts = invoice_text(spark, folder).select("doc_id", "key", "file_hash")
    arrival = F.timestamp_add("DAY", F.pmod("key", F.lit(20)).cast("int"), F.lit("2026-01-01").cast("timestamp"))
    texts = stage(texts.withColumn("received_at", arrival), "texts")

    def again(tenth: int, days: int) -> DataFrame:
        later = F.timestamp_add("DAY", F.lit(days), F.col("received_at"))
        return texts.where(F.col("key") % 10 == tenth).withColumn("received_at", later)

    path, out, progress = (work_dir(spark, name) for name in ("inbox", "unique", "progress"))
    for delivery in (texts, again(0, 5), again(0, 120), again(1, 125)):
        delivery.write.mode("append").parquet(path)
        stream = spark.readStream.schema(texts.schema).parquet(path).select("doc_id", "file_hash", "received_at")
        (intake.without_redeliveries(stream, "30 days").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("doc_id", "file_hash")
