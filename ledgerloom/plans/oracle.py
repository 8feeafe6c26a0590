"""ANSI SQL that answers the catalog's queries on the same tables, for the comparison.

Written on its own: plain, unoptimised SQL over whole tables. Only the fixed
values (patterns, lists, templates) are shared with the package.
"""

from __future__ import annotations

from ledgerloom import fixed
from ledgerloom.functions.dates import MONTH_KEYS, SHAPES
from ledgerloom.operators import languages


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def pick(key: str, values) -> str:
    """Literal list element by key modulo its length."""
    return f"list_extract([{', '.join(lit(v) for v in values)}], CAST({key} % {len(values)} AS BIGINT) + 1)"


def cents_text(c: str, sym: str) -> str:
    return (f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || {sym} || format('{{:,}}', abs({c}) // 100) || '.' || "
            f"lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))")


def money_text(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR)"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, {lit(fixed.WHITESPACE)}, ' ', 'g'))"


def stripped(t: str) -> str:
    edge = f"^{fixed.WHITESPACE}|{fixed.WHITESPACE}\\z"
    return f"regexp_replace(coalesce({t}, ''), {lit(edge)}, '', 'g')"


def ascii_digits(t: str) -> str:
    return f"translate({t}, {lit(fixed.FOREIGN_DIGITS)}, {lit(fixed.ASCII_DIGITS)})"


def first_match(t: str, patterns) -> str:
    hits = [f"nullif(trim(regexp_extract({t}, {lit(p)}, 1)), '')" for p in patterns]
    return f"coalesce({', '.join(hits)}, '')"


def parse_amount(v: str) -> str:
    kept = f"regexp_replace({ascii_digits(v)}, '[^0-9.,\\-]', '', 'g')"
    return (f"TRY_CAST(CASE WHEN regexp_matches({kept}, '^-?\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?\\z') "
            f"THEN replace(replace({kept}, '.', ''), ',', '.') ELSE replace({kept}, ',', '') END AS DOUBLE)")


def read_date(c: str) -> str:
    reads = []
    for pattern, order in SHAPES:
        parts = []
        for code in order.split("-"):
            value = f"regexp_extract({c}, {lit(pattern)}, {code[-1]})"
            if code[0] == "m":
                value = f"CAST((instr('{MONTH_KEYS}', lower(substr({value}, 1, 3))) + 2) // 3 AS VARCHAR)"
            elif code[0] == "c":
                value = f"((CASE WHEN {value} >= '69' THEN '19' ELSE '20' END) || {value})"
            parts.append(value)
        iso = " || '-' || ".join(parts)
        reads.append(f"CASE WHEN regexp_matches({c}, {lit(pattern)}) THEN TRY_CAST({iso} AS DATE) END")
    return f"coalesce({', '.join(reads)})"


def iso(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


# --- derived tables ----------------------------------------------------------

_T = fixed.TEMPLATES
_KEYED = {"lang": 1, "base_currency": 2, "sym": 3, "vendor": 4, "buyer": 5, "subtotal_label": 6,
          "tax_label": 7, "tax_rate": 8, "total_label": 9, "note": 10}

FACTS = f"""
line_cents AS (
  SELECT *,
    CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS amount_c,
    CAST(floor(l_extendedprice * (1 - l_discount) * l_tax * 100 + 0.5) AS BIGINT) AS tax_c,
    CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS discount_c,
    CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS unit_c
  FROM lineitem),
order_sums AS (
  SELECT l_orderkey AS key, CAST(sum(amount_c) AS BIGINT) AS subtotal_c, CAST(sum(tax_c) AS BIGINT) AS raw_tax_c,
    CAST(sum(discount_c) AS BIGINT) AS raw_discount_c, min(l_suppkey) AS supp
  FROM line_cents GROUP BY l_orderkey),
order_base AS (
  SELECT s.*, o_custkey AS cust, CAST(o_orderdate AS DATE) AS order_day,
    {', '.join(f"{pick('s.key', [t[i] for t in _T])} AS {name}" for name, i in _KEYED.items())}
  FROM order_sums s JOIN orders ON o_orderkey = s.key),
dated AS (
  SELECT *, CASE WHEN key % 41 = 0 THEN DATE '2099-12-31' WHEN key % 43 = 0 THEN order_day
    ELSE CAST(order_day + INTERVAL {fixed.DATE_SHIFT_YEARS} YEAR AS DATE) END AS invoice_day,
    CASE WHEN key % 31 = 0 AND key > 0 THEN key - 1 ELSE key END AS number_key
  FROM order_base),
facts AS (
  SELECT key, lang, sym, subtotal_c, subtotal_label, tax_label, tax_rate, total_label, note,
    'INV-' || CASE WHEN length(CAST(number_key AS VARCHAR)) < 6 THEN lpad(CAST(number_key AS VARCHAR), 6, '0')
      ELSE CAST(number_key AS VARCHAR) END AS invoice_number,
    invoice_day,
    CAST(CASE WHEN key % 37 = 0 THEN invoice_day - 10 ELSE invoice_day + 30 END AS DATE) AS due_day,
    CASE WHEN key % 29 = 0 THEN '' ELSE vendor || ' ' || supp END AS vendor_name,
    buyer || ' ' || cust AS buyer_name,
    CASE WHEN key % 59 = 0 THEN -raw_tax_c ELSE raw_tax_c END AS tax_c,
    CASE WHEN key % 53 = 0 THEN NULL WHEN key % 23 = 0 THEN subtotal_c + raw_tax_c + (subtotal_c + raw_tax_c) // 5
      ELSE subtotal_c + raw_tax_c END AS total_c,
    CASE WHEN key % 5 = 0 THEN raw_discount_c END AS discount_c,
    CASE WHEN key % 47 = 0 THEN 'us dollars' ELSE base_currency END AS currency,
    CASE WHEN base_currency = 'INR' THEN {lit(fixed.GSTIN_LINE)}
      WHEN base_currency IN ('EUR', 'GBP') THEN 'VAT No: ' || upper(lang) || '{fixed.VAT_DIGITS}' ELSE '' END AS tax_id_line,
    CASE WHEN key % 3 = 0 THEN 'PO-' || CASE WHEN length(CAST(cust AS VARCHAR)) < 6
      THEN lpad(CAST(cust AS VARCHAR), 6, '0') ELSE CAST(cust AS VARCHAR) END ELSE '' END AS po_number,
    'invoice_' || key || {pick('key', fixed.FILE_EXTENSIONS)} AS filename,
    CAST(invoice_day AS TIMESTAMP) + to_seconds(key % 86400) AS received_at
  FROM dated)"""

_SHOWN_DATE = (
    "CASE key % 7 WHEN 0 THEN strftime(invoice_day, '%B %-d, %Y') WHEN 1 THEN strftime(invoice_day, '%d/%m/%Y') "
    "WHEN 2 THEN strftime(invoice_day, '%d-%m-%Y') WHEN 3 THEN strftime(invoice_day, '%d.%m.%Y') "
    "WHEN 4 THEN strftime(invoice_day, '%-d %B %Y') WHEN 5 THEN strftime(invoice_day, '%Y/%m/%d') "
    "ELSE strftime(invoice_day, '%Y-%m-%d') END"
)
_LINE_SYM = pick("l_orderkey", [t[3] for t in _T])

TEXTS = FACTS + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_quantity, l_discount, l_tax) AS rn FROM line_cents),
items AS (
  SELECT l_orderkey, string_agg('Part ' || l_partkey || ' ' || CAST(l_quantity AS BIGINT) || ' '
    || {cents_text('unit_c', _LINE_SYM)} || ' ' || {cents_text('amount_c', _LINE_SYM)}, chr(10) ORDER BY rn) AS items
  FROM ranked GROUP BY l_orderkey),
rendered AS (
  SELECT key + 1 AS doc_id, f.*, concat_ws(chr(10),
    'INVOICE', 'Invoice No: ' || invoice_number, 'Invoice Date: ' || {_SHOWN_DATE},
    'Due Date: ' || strftime(due_day, '%d/%m/%Y'), 'Currency: ' || currency,
    CASE WHEN po_number <> '' THEN 'PO No: ' || po_number END, '',
    CASE WHEN vendor_name <> '' THEN 'From: ' || vendor_name END, {lit(fixed.SELLER_STREET)},
    'Bill To: ' || buyer_name, {lit(fixed.BUYER_STREET)}, '',
    CASE WHEN tax_id_line <> '' THEN tax_id_line END, {lit(fixed.ITEM_HEADER)}, items, '',
    'Discount: ' || {cents_text('discount_c', 'sym')},
    subtotal_label || ': ' || {cents_text('subtotal_c', 'sym')},
    tax_label || ' (' || tax_rate || '): ' || {cents_text('tax_c', 'sym')},
    total_label || ': ' || {cents_text('total_c', 'sym')}, '',
    {lit(fixed.TERMS_LINE)}, {lit(fixed.BANK_LINE)}, note) AS text
  FROM facts f JOIN items ON l_orderkey = key),
texts AS (SELECT doc_id, key, filename, sha256(text) AS file_hash, text, received_at FROM rendered)"""

_HIGH = {"invoice_number", "invoice_date", "vendor_name", "buyer_name", "total_amount", "tax_id", "po_number"}


def _mean(scores: list[str]) -> str:
    total = " + ".join(f"floor({s} * 10000 + 0.5)" for s in scores)
    return f"floor(({total}) / {len(scores)} + 0.5) / 10000"


KNOWN = FACTS + f""",
known AS (
  SELECT key + 1 AS id, key, filename, received_at, invoice_number, {iso('invoice_day')} AS invoice_date,
    {iso('due_day')} AS due_date, vendor_name, buyer_name, total_c / 100 AS total_amount, subtotal_c / 100 AS subtotal,
    tax_c / 100 AS tax_amount, tax_rate, CASE WHEN key % 67 = 0 THEN (0 - discount_c) / 100 ELSE discount_c / 100 END AS discount,
    currency, CASE WHEN key % 71 = 0 THEN 'GST/27' ELSE regexp_extract(tax_id_line, ': (.*)', 1) END AS tax_id,
    CASE WHEN key % 61 = 0 THEN 'P1' ELSE po_number END AS po_number,
    buyer_name || ' ' || {lit(fixed.BUYER_STREET)} AS address, {lit(fixed.TERMS)} AS payment_terms, lang AS detected_language
  FROM facts),
scored AS (
  SELECT *, {_mean([f'score_{k}' for k in fixed.CONFIDENCE_KEYS])} AS avg_field_confidence,
    CASE WHEN key % 5 = 0 THEN 'easyocr' ELSE 'tesseract' END AS ocr_engine, (key % 41 + 60) / 100 AS ocr_confidence
  FROM (SELECT *, {', '.join(
      f"CAST(CASE WHEN coalesce(CAST({k} AS VARCHAR), '') <> '' THEN {fixed.CONF_HIGH if k in _HIGH else fixed.CONF_MEDIUM} "
      f"ELSE {fixed.CONF_LOW} END AS DOUBLE) AS score_{k}" for k in fixed.CONFIDENCE_KEYS)} FROM known))"""


def _duplicates(source: str) -> str:
    return f"""
flagged AS (
  SELECT s.*, coalesce(n, 0) > 1 AS is_duplicate, CASE WHEN n > 1 THEN CASE WHEN s.id = ids[1] THEN ids[2] ELSE ids[1] END END AS duplicate_of
  FROM {source} s LEFT JOIN (SELECT invoice_number AS num, count(*) AS n, list(id ORDER BY id) AS ids FROM {source}
    WHERE coalesce(invoice_number, '') <> '' GROUP BY 1) g ON num = s.invoice_number)"""


# --- validation --------------------------------------------------------------

def _c(x: str) -> str:
    return f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"


_NUM = "coalesce(invoice_number, '')"
_CUR = "coalesce(currency, '')"
_MANDATORY = [
    (f, f"coalesce({f} = 0, true)" if f == "total_amount" else f"{squeeze(f'coalesce({f}, {lit(str())})')} = ''")
    for f in fixed.MANDATORY_FIELDS
]
_OFF = f"abs({_c('subtotal')} + {_c('tax_amount')} - {_c('total_amount')})"
_BEYOND = f"{_OFF} * 100 > {_c('total_amount')} * {fixed.TOTAL_TOLERANCE_PERCENT}"
_FUTURE = f"_day > DATE '{fixed.AS_OF}'"

RULES = {
    "mandatory": [
        *[("errors", missing, lit(f"Missing mandatory field: '{f}'")) for f, missing in _MANDATORY],
        *[("passed", f"NOT ({missing})", lit(f"Mandatory field present: '{f}'")) for f, missing in _MANDATORY],
    ],
    "number": [
        ("warnings", f"{_NUM} <> '' AND length({_NUM}) < 3", f"'Invoice number ''' || {_NUM} || ''' is suspiciously short'"),
        ("warnings", f"length({_NUM}) > 30", f"'Invoice number ''' || {_NUM} || ''' exceeds expected length'"),
        ("passed", f"length({_NUM}) BETWEEN 3 AND 30", "'Invoice number format valid'"),
        ("errors", f"{_NUM} <> '' AND NOT regexp_matches({_NUM}, '[A-Za-z0-9]')",
         f"'Invoice number ''' || {_NUM} || ''' contains no alphanumeric characters'"),
    ],
    "dates": [
        ("warnings", "coalesce(invoice_date, '') <> '' AND _day IS NULL", "'Could not parse invoice date: ''' || invoice_date || ''''"),
        ("warnings", _FUTURE, "'Invoice date ' || invoice_date || ' is in the future'"),
        ("warnings", f"NOT ({_FUTURE}) AND year(_day) < 2000", "'Invoice date ' || invoice_date || ' may be incorrect (year < 2000)'"),
        ("passed", f"NOT ({_FUTURE}) AND year(_day) >= 2000", "'Invoice date is valid'"),
        ("errors", "_due < _day", "'Due date is before invoice date — logically inconsistent'"),
        ("passed", "_due >= _day", "'Due date is after invoice date'"),
    ],
    "amounts": [
        ("errors", "total_amount <= 0", f"'Total amount is non-positive: ' || {money_text('total_amount')}"),
        ("passed", "total_amount > 0", f"'Total amount present: ' || {money_text('total_amount')}"),
        ("warnings", _BEYOND,
         f"'Arithmetic inconsistency: subtotal (' || {money_text('subtotal')} || ') + tax (' || {money_text('tax_amount')} || ') = ' || "
         f"{money_text(f'''({_c('subtotal')} + {_c('tax_amount')}) / 100''')} || ' but total is ' || {money_text('total_amount')} || "
         f"' (diff=' || {money_text(f'{_OFF} / 100')} || ')'"),
        ("passed", f"NOT ({_BEYOND})", "'Subtotal + tax ≈ total (arithmetic consistent)'"),
        ("warnings", "subtotal > total_amount",
         f"'Subtotal (' || {money_text('subtotal')} || ') exceeds total (' || {money_text('total_amount')} || ')'"),
        ("warnings", "tax_amount < 0", f"'Tax amount is negative: ' || {money_text('tax_amount')}"),
    ],
    "currency": [
        ("warnings", f"{_CUR} <> '' AND NOT regexp_matches({_CUR}, '^[A-Z]{{3}}\\z')", f"'Non-standard currency format: ''' || {_CUR} || ''''"),
        ("passed", f"regexp_matches({_CUR}, '^[A-Z]{{3}}\\z')", f"'Currency code valid: ' || {_CUR}"),
    ],
    "duplicate": [
        ("warnings", "is_duplicate", f"'Duplicate invoice number ''' || {_NUM} || ''' found (ID: ' || duplicate_of || ')'"),
    ],
    "strict": [
        ("warnings", "discount < 0", f"'Discount is negative: ' || {money_text('discount')}"),
        ("warnings", "coalesce(tax_id, '') <> '' AND NOT regexp_matches(tax_id, '^[A-Za-z0-9\\-]{5,20}\\z')",
         "'Tax id has an unknown shape: ''' || tax_id || ''''"),
        ("warnings", "coalesce(po_number, '') <> '' AND length(po_number) NOT BETWEEN 3 AND 20",
         "'PO number has an unusual length: ''' || po_number || ''''"),
    ],
}
_STATUS_RULES = ["mandatory", "number", "dates", "amounts", "currency", "duplicate"]
KINDS = ["passed", "warnings", "errors"]


def _messages(groups: list[str], kind: str) -> list[str]:
    return [f"CASE WHEN {cond} THEN {text} END" for g in groups for k, cond, text in RULES[g] if k == kind]


def _joined(groups: list[str], kind: str) -> str:
    found = _messages(groups, kind)
    return f"concat_ws('; ', {', '.join(found)})" if found else "''"


def _as_list(groups: list[str], kind: str) -> str:
    return f"list_filter([{', '.join(_messages(groups, kind))}], lambda m: m IS NOT NULL)"


def _with_days(source: str) -> str:
    clean = lambda c: squeeze(ascii_digits(f"coalesce({c}, '')"))
    return f"""
cleaned AS (SELECT *, {clean('invoice_date')} AS _it, {clean('due_date')} AS _dt FROM {source}),
days AS (SELECT *, {read_date('_it')} AS _day, {read_date('_dt')} AS _due FROM cleaned)"""


def _validated(source: str) -> str:
    return _duplicates(source) + "," + _with_days("flagged") + f""",
reports AS (SELECT *, {', '.join(f"{_as_list(_STATUS_RULES, k)} AS {k}" for k in KINDS)} FROM days),
validated AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'FAILED' WHEN len(warnings) > 0 THEN 'WARNING' ELSE 'PASSED' END
  AS validation_status FROM reports)"""


VALID = KNOWN + "," + _validated("scored")
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_RECORD = ", ".join(c for c in fixed.RECORD_COLUMNS if c != "processed_at")
RECORDS = VALID + f""",
records AS (SELECT {_RECORD}, received_at AS processed_at, {_STAMP.format('received_at')} AS stamp, errors FROM validated)"""
_VIEW = f"{_RECORD}, stamp AS processed_at"
_REPORT = ("CAST(to_json({'status': validation_status, 'passed': passed, 'warnings': warnings, 'errors': errors, "
           "'is_duplicate': is_duplicate}) AS VARCHAR)")


def _score_json(prefix: str = "score_") -> str:
    return "CAST(to_json({" + ", ".join(f"'{k}': {prefix}{k}" for k in fixed.CONFIDENCE_KEYS) + "}) AS VARCHAR)"


# --- language ----------------------------------------------------------------

def script_code(t: str) -> str:
    """Dominant script of a text or ''."""
    entries = ", ".join(
        f"{{'n': length(regexp_replace({t}, '[^{b}]', '', 'g')), 'at': instr({t}, regexp_extract({t}, '[{b}]')), 'code': '{c}'}}"
        for c, b in fixed.SCRIPT_CLASSES.items())
    ordered = f"list_sort(list_transform([{entries}], lambda e: {{'r': -e.n, 'at': e.at, 'code': e.code}}))"
    return f"CASE WHEN -({ordered}[1].r) > {fixed.MIN_SCRIPT_CHARS} THEN {ordered}[1].code ELSE '' END"


def word_profile(source: str, keep: str) -> str:
    """CTEs: words (hit words of a text) and profile (best language and its hits)."""
    langs = list(fixed.LANGUAGE_WORDS)
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN {in_list(fixed.LANGUAGE_WORDS[c])})) AS n_{c}" for c in langs)
    top = f"greatest({', '.join(f'n_{c}' for c in langs)})"
    best = " ".join(f"WHEN n_{c} = {top} THEN '{c}'" for c in langs)
    return f"""
words AS (SELECT {keep}, regexp_extract_all(lower(text), {lit(fixed.TOKEN)}) AS w FROM {source}),
counted AS (SELECT {keep}, {counts} FROM words),
profile AS (SELECT {keep}, CASE WHEN {top} = 0 THEN '' {best} END AS detected, {top} AS hits FROM counted)"""


def _language(source: str) -> str:
    return word_profile(source, "doc_id") + f""",
lang_codes AS (SELECT t.doc_id, CASE WHEN length({stripped('t.text')}) < {fixed.MIN_DETECT_LENGTH} THEN 'en'
  ELSE coalesce(CASE WHEN {script_code('t.text')} = 'zh' AND regexp_matches(t.text, {lit(fixed.KANA)}) THEN 'ja' END,
    nullif({script_code('t.text')}, ''), nullif(detected, ''), 'en') END AS lang_code
  FROM {source} t JOIN profile USING (doc_id))"""


def _slice(key: str) -> str:
    return f"(('0x' || substr(sha256(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 1000)"


def _trigram_model() -> str:
    """CTEs: pieces (trigrams of every text) and best (language and score of every text), learned from documents."""
    learnt = f"""SELECT doc_id FROM documents, (SELECT least({1000 - languages.HELD_OUT}, 1000 * {languages.TRAIN_TEXTS} // count(*)) AS share
      FROM documents WHERE lang IN {in_list(fixed.LANGUAGE_NAMES)} AND text IS NOT NULL)
    WHERE lang IN {in_list(fixed.LANGUAGE_NAMES)} AND {_slice('doc_id')} < share"""
    return f"""
spelt AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM documents),
pieces AS (SELECT doc_id, lang, substr(' ' || w || ' ', i, 3) AS gram, count(*) AS n
  FROM (SELECT doc_id, lang, w, unnest(range(1, length(w) + 1)) AS i FROM spelt) GROUP BY ALL),
seen AS (SELECT lang, gram, sum(n) AS n FROM pieces WHERE doc_id IN ({learnt}) GROUP BY ALL),
kept AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM seen)
  WHERE r <= {languages.GRAMS}),
totals AS (SELECT lang, sum(n) + (SELECT count(*) FROM kept) AS total FROM seen GROUP BY lang),
weights AS (SELECT gram, t.lang AS code, CAST(round({languages.WEIGHT_SCALE} * ln((coalesce(s.n, 0) + 1) / CAST(total AS DOUBLE))) AS BIGINT) AS w
  FROM kept CROSS JOIN totals t LEFT JOIN seen s USING (gram, lang)),
rated AS (SELECT doc_id, t.lang AS code, sum(n) AS n_grams, CAST(sum(n * coalesce(w,
    CAST(round({languages.WEIGHT_SCALE} * ln(1 / CAST(total AS DOUBLE))) AS BIGINT))) AS BIGINT) AS score
  FROM pieces p CROSS JOIN totals t LEFT JOIN weights x ON x.gram = p.gram AND x.code = t.lang GROUP BY ALL),
best AS (SELECT doc_id, code, score, CAST(n_grams AS BIGINT) AS n_grams FROM rated
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1),
profile AS (SELECT doc_id, lang, coalesce(code, '') AS detected, score, coalesce(n_grams, 0) AS n_grams
  FROM documents LEFT JOIN best USING (doc_id))"""


# --- extraction --------------------------------------------------------------

def _currency() -> str:
    symbols = " ".join(f"WHEN contains(r_total, {lit(s)}) THEN '{c}'" for s, c in fixed.CURRENCY_SYMBOLS.items())
    far = " ".join(f"WHEN r_currency = {lit(s)} THEN '{c}'" for s, c in fixed.CURRENCY_SYMBOLS.items())
    code = f"regexp_extract(r_total, {lit(fixed.CURRENCY_CODE_IN_AMOUNT)}, 1)"
    return (f"coalesce(CASE WHEN {code} <> '' THEN upper({code}) {symbols} WHEN regexp_matches(r_total, {lit(fixed.RAND_AMOUNT)}) "
            f"THEN 'ZAR' END, CASE WHEN regexp_matches(r_currency, {lit(fixed.ISO_CURRENCY)}) THEN r_currency {far} END, '')")


_RAW = {
    "number": first_match("t", fixed.NUMBER_PATTERNS),
    "number_bare": first_match("t", [fixed.NUMBER_FALLBACK]),
    "date": squeeze(first_match(f"regexp_replace(d, {lit(fixed.DUE_LABEL)}, '~', 'g')", fixed.DATE_PATTERNS)),
    "date_bare": first_match("d", [fixed.DATE_FALLBACK]),
    "due": squeeze(first_match("d", fixed.DUE_PATTERNS)),
    "vendor": first_match("t", fixed.VENDOR_PATTERNS),
    "buyer": first_match("t", fixed.BUYER_PATTERNS),
    "total": first_match("m", fixed.TOTAL_PATTERNS),
    "subtotal": first_match("d", fixed.SUBTOTAL_PATTERNS),
    "rate": first_match("m", fixed.TAX_RATE_PATTERNS),
    "tax": first_match("m", fixed.TAX_AMOUNT_PATTERNS),
    "discount": first_match("d", fixed.DISCOUNT_PATTERNS),
    "currency": first_match("t", fixed.CURRENCY_PATTERNS),
    "tax_id": first_match("t", fixed.TAX_ID_PATTERNS),
    "po": first_match("t", fixed.PO_PATTERNS),
    "address": first_match("t", fixed.ADDRESS_PATTERNS),
    "terms": squeeze(first_match("t", fixed.TERMS_PATTERNS)),
}
_SCORE = {
    "invoice_number": ("r_number <> ''", fixed.CONF_HIGH, "r_number_bare <> ''"),
    "invoice_date": ("r_date <> ''", fixed.CONF_HIGH, None),
    "due_date": ("r_due <> ''", fixed.CONF_MEDIUM, None),
    "vendor_name": ("r_vendor <> ''", fixed.CONF_HIGH, None),
    "buyer_name": ("r_buyer <> ''", fixed.CONF_HIGH, None),
    "total_amount": ("r_total <> ''", fixed.CONF_HIGH, None),
    "subtotal": ("r_subtotal <> ''", fixed.CONF_MEDIUM, None),
    "tax_amount": ("r_tax <> '' OR r_rate <> ''", fixed.CONF_MEDIUM, None),
    "currency": ("currency <> ''", fixed.CONF_MEDIUM, None),
    "tax_id": ("r_tax_id <> ''", fixed.CONF_HIGH, None),
    "po_number": ("r_po <> ''", fixed.CONF_HIGH, None),
    "address": ("r_address <> ''", fixed.CONF_MEDIUM, None),
    "payment_terms": ("r_terms <> ''", fixed.CONF_MEDIUM, None),
}


def _score_sql(key: str) -> str:
    hit, score, backup = _SCORE[key]
    second = f"WHEN {backup} THEN {fixed.CONF_MEDIUM} " if backup else ""
    return f"CAST(CASE WHEN {hit} THEN {score} {second}ELSE {fixed.CONF_LOW} END AS DOUBLE) AS score_{key}"


EXTRACTED = TEXTS + f""",
lined AS (SELECT *, regexp_replace(coalesce(text, ''), {lit(fixed.LINE_BLANKS)}, ' ', 'g') AS t FROM texts),
digits AS (SELECT *, {ascii_digits('t')} AS d FROM lined),
masked AS (SELECT *, regexp_replace(d, {lit(fixed.NOT_TOTAL)}, '~', 'g') AS m FROM digits),
captured AS (SELECT *, {', '.join(f"{sql} AS r_{name}" for name, sql in _RAW.items())} FROM masked),
shown AS (SELECT *, coalesce(nullif(r_date, ''), nullif(r_date_bare, ''), '') AS date_text FROM captured),
fielded AS (
  SELECT doc_id, key, filename, file_hash, text, {', '.join(f'r_{n}' for n in _RAW)},
    coalesce(nullif(r_number, ''), nullif(r_number_bare, ''), '') AS invoice_number,
    coalesce({iso(read_date('date_text'))}, date_text) AS invoice_date,
    coalesce({iso(read_date('r_due'))}, r_due) AS due_date,
    r_vendor AS vendor_name, r_buyer AS buyer_name,
    {parse_amount('r_total')} AS total_amount, {parse_amount('r_subtotal')} AS subtotal,
    {parse_amount('r_tax')} AS tax_amount, nullif(r_rate, '') AS tax_rate, {parse_amount('r_discount')} AS discount,
    {_currency()} AS currency, r_tax_id AS tax_id, r_po AS po_number,
    {squeeze('r_address')} AS address, r_terms AS payment_terms
  FROM shown),
graded AS (SELECT *, {', '.join(_score_sql(k) for k in fixed.CONFIDENCE_KEYS)} FROM fielded)"""

_EXTENSION = "lower(regexp_extract(filename, '[^/](\\.[^./]+)\\z', 1))"
_SUPPORTED = f"{_EXTENSION} IN {in_list(fixed.SUPPORTED_EXTENSIONS)}"
_FIELDS = ", ".join(fixed.FIELD_COLUMNS)

PROCESSED = EXTRACTED + "," + _language("texts") + f""",
processed AS (SELECT g.*, lang_code AS detected_language, doc_id AS id,
  {_mean([f'score_{k}' for k in fixed.CONFIDENCE_KEYS])} AS avg_field_confidence,
  CASE WHEN key % 5 = 0 THEN 'easyocr' ELSE 'tesseract' END AS ocr_engine, (key % 41 + 60) / 100 AS ocr_confidence
  FROM graded g JOIN lang_codes USING (doc_id)),
good AS (SELECT * FROM processed WHERE {_SUPPORTED})""" + "," + _validated("good") + f""",
results AS (
  SELECT p.doc_id, p.filename, p.file_hash, v.doc_id IS NOT NULL AS success,
    CASE WHEN v.doc_id IS NULL THEN 'Unsupported file type: ' || {_EXTENSION.replace('filename', 'p.filename')} END AS error,
    p.ocr_engine, p.ocr_confidence, {', '.join(f'v.{c}' for c in fixed.FIELD_COLUMNS)}, v.avg_field_confidence,
    v.validation_status, v.is_duplicate, v.report
  FROM processed p LEFT JOIN (SELECT *, {_REPORT} AS report FROM validated) v ON v.doc_id = p.doc_id)"""


def _with(base: str, select: str) -> str:
    return f"WITH {base}\n{select}"


# --- pages -------------------------------------------------------------------

_CONF = "CAST((conv_id * 31 + turn * 17 + pos * 7) % 101 AS DOUBLE)"
PAGES = f"""
split_words AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word,
  unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM conversations),
rated AS (SELECT *, {_CONF} AS conf FROM split_words),
engine_a AS (SELECT conv_id AS doc_id, turn AS page_no, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (keep), '') AS text,
  coalesce(avg(conf) FILTER (keep), 0) AS conf
  FROM (SELECT *, {stripped('word')} <> '' AND conf > 0 AS keep FROM rated) GROUP BY 1, 2),
engine_b AS (SELECT conv_id AS doc_id, turn AS page_no, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (keep), '') AS text,
  coalesce(avg(conf / 100) FILTER (keep), 0) * 100 AS conf
  FROM (SELECT *, {stripped('word')} <> '' AND ((conv_id + turn) % 2 = 1 OR pos % 5 <> 0) AS keep FROM rated) GROUP BY 1, 2),
compared AS (SELECT a.doc_id, a.page_no, a.text AS a_text, a.conf AS a_conf, b.text AS b_text, b.conf AS b_conf,
  coalesce((a.conf < {fixed.RECOGNISER_THRESHOLD} OR length({stripped('a.text')}) < {fixed.RECOGNISER_MIN_LENGTH})
    AND length({stripped('b.text')}) > length({stripped('a.text')}), false) AS use_b
  FROM engine_a a LEFT JOIN engine_b b ON a.doc_id = b.doc_id AND a.page_no = b.page_no),
chosen AS (SELECT doc_id, page_no, CASE WHEN use_b THEN b_text ELSE a_text END AS text,
  (CASE WHEN use_b THEN b_conf ELSE a_conf END) / 100 AS conf, CASE WHEN use_b THEN 'easyocr' ELSE 'tesseract' END AS engine FROM compared)"""
_R6 = "floor(conf * 1000000.0 + 0.5) / 1000000.0 AS conf"

# --- search ------------------------------------------------------------------

def stem(t: str) -> str:
    """Porter's steps one inside the other; each result is bound to a name by a list of one element."""
    groups = ("[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*")
    some = f"^({groups[0]})?{groups[1]}{groups[0]}"
    more = some + groups[1] + groups[0]
    one = f"{some}({groups[1]})?$"
    vowel, short = f"^({groups[0]})?[aeiouy]", f"^{groups[0]}[aeiouy][^aeiouwxy]$"
    double = "(" + "|".join(c + c for c in "bcdfghjkmnpqrtvwx") + ")$"

    def has(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def less(x: str, n) -> str:
        return f"substr({x}, 1, length({x}) - {n})"

    def let(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def suffixes(w: str, at: str, becomes: dict[str, str], condition: str) -> str:
        new = " ".join(f"WHEN '{old}' THEN '{x}'" for old, x in becomes.items())
        left = less(w, f"length({at})")
        return let(f"regexp_extract({w}, '({'|'.join(becomes)})$', 1)", at,
                   f"CASE WHEN {at} <> '' AND {has(left, condition)} AND ({at} <> 'ion' OR {has(left, '[st]$')}) "
                   f"THEN {left} || CASE {at} {new} END ELSE {w} END")

    mended = (f"CASE WHEN {has('p', '(at|bl|iz)$')} THEN p || 'e' WHEN {has('p', double)} THEN {less('p', 1)} "
              f"WHEN {has('p', short)} THEN p || 'e' ELSE p END")
    bodies = [
        lambda w: f"CASE WHEN {has(w, '(ss|i)es$')} THEN {less(w, 2)} WHEN {has(w, '[^s]s$')} THEN {less(w, 1)} ELSE {w} END",
        lambda w: (f"CASE WHEN {has(w, 'eed$')} THEN CASE WHEN {has(less(w, 3), some)} THEN {less(w, 1)} ELSE {w} END ELSE coalesce("
                   + let(f"CASE WHEN {has(w, 'ed$')} THEN {less(w, 2)} WHEN {has(w, 'ing$')} THEN {less(w, 3)} END", "p",
                         f"CASE WHEN {has('p', vowel)} THEN {mended} END") + f", {w}) END"),
        lambda w: f"CASE WHEN {has(w, 'y$')} AND {has(less(w, 1), vowel)} THEN {less(w, 1)} || 'i' ELSE {w} END",
        lambda w: suffixes(w, "s2", fixed.PORTER_STEP_2, some),
        lambda w: suffixes(w, "s3", fixed.PORTER_STEP_3, some),
        lambda w: suffixes(w, "s4", dict.fromkeys(fixed.PORTER_STEP_4, ""), more),
        lambda w: (f"CASE WHEN {has(w, 'e$')} AND ({has(less(w, 1), more)} OR ({has(less(w, 1), one)} AND NOT {has(less(w, 1), short)})) "
                   f"THEN {less(w, 1)} ELSE {w} END"),
        lambda w: f"CASE WHEN {has(w, 'll$')} AND {has(w, more)} THEN {less(w, 1)} ELSE {w} END"]
    stemmed = f"regexp_replace({t}, '^y', 'Y')"
    for i, body in enumerate(bodies):
        stemmed = let(stemmed, f"w{i}", body(f"w{i}"))
    return f"CASE WHEN {has(t, '^[a-z]{3,}$')} THEN lower({stemmed}) ELSE {t} END"


def index_tokens(t: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({t}), {lit(fixed.TOKEN)}), "
            f"lambda w: length(w) >= 2 AND w NOT IN {in_list(fixed.SEARCH_STOP_WORDS)})")


def _word_requests() -> str:
    worth = f"length(w) >= 2 AND w NOT IN {in_list(fixed.SEARCH_STOP_WORDS)}"
    return f"""
items AS (SELECT CAST(item_id AS BIGINT) AS k, string_split_regex(lower(trim(text)), '[^\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
asked AS (SELECT k * 3 AS query_id, 'phrase' AS kind, CASE WHEN k % 10 = 3 THEN list_append(w[3:4], 'qqzzq') ELSE w[3:5] END AS ws FROM items WHERE len(w) >= 5
  UNION ALL SELECT k * 3 + 1, 'prefix', [substr(w[2], 1, 4)] FROM items WHERE len(w) >= 5
  UNION ALL SELECT k * 3 + 2, 'any', [w[1], w[-2]] FROM items WHERE len(w) >= 5),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS place FROM (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {lit(fixed.TOKEN)}) AS ws FROM documents)),
spelt AS (SELECT w, {stem('w')} AS term FROM (SELECT DISTINCT w FROM tok UNION SELECT DISTINCT unnest(ws) FROM asked)),
held AS (SELECT doc_id, w, place, term FROM tok JOIN spelt USING (w) WHERE {worth}),
words AS (SELECT query_id, kind, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM asked),
need AS (SELECT query_id, kind, w, pos, term FROM words JOIN spelt USING (w) WHERE {worth}),
needed AS (SELECT query_id, count(*) AS n FROM need WHERE kind = 'phrase' GROUP BY 1),
met AS (SELECT query_id, doc_id, place - pos AS start, count(DISTINCT pos) AS n FROM need JOIN held USING (term)
  WHERE kind = 'phrase' GROUP BY ALL),
answers AS (
  SELECT query_id, 'phrase' AS kind, doc_id, count(*) AS n FROM met m JOIN needed d USING (query_id) WHERE m.n = d.n GROUP BY ALL
  UNION ALL SELECT query_id, 'prefix', doc_id, count(DISTINCT h.w) FROM words q JOIN held h ON starts_with(h.w, q.w)
    WHERE kind = 'prefix' AND length(q.w) >= 2 GROUP BY ALL
  UNION ALL SELECT query_id, 'any', doc_id, count(DISTINCT term) FROM need JOIN held USING (term) WHERE kind = 'any' GROUP BY ALL)"""


def _postings(rows: list[tuple[str, str, str]], name: str = "postings") -> str:
    """rows: (field, source, text column); the invoice number is one whole token."""
    parts = []
    for field, source, column in rows:
        words = f"CASE WHEN {column} <> '' THEN [lower({column})] ELSE [] END" if field == "invoice_number" else index_tokens(column)
        parts.append(f"SELECT '{field}' AS field, id AS doc_id, {words} AS ws FROM {source}")
    return f"""
{name}_words AS ({' UNION ALL '.join(parts)}),
{name}_tokens AS (SELECT field, doc_id, CAST(len(ws) AS BIGINT) AS len, unnest(ws) AS w FROM {name}_words),
{name} AS (SELECT field, CASE WHEN field = 'invoice_number' THEN w ELSE {stem('w')} END AS term, doc_id, count(*) AS tf, len
  FROM {name}_tokens GROUP BY ALL)"""


_SUPP_WORD = [t[4].split(" ")[0] for t in _T]
_SUPP_SECOND = [t[4].split(" ")[1] for t in _T]
MIXED = f"""
asked AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 10 WHEN 7 THEN NULL WHEN 8 THEN 'the of and'
    ELSE {pick('s_suppkey', _SUPP_WORD)} || ' ' || s_suppkey END AS q,
  CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 10 <> 8 THEN {pick('s_suppkey', _SUPP_SECOND)} END AS vendor,
  CASE WHEN s_suppkey % 3 = 0 THEN {pick('s_suppkey', [t[2] for t in _T])} END AS f_currency,
  CASE WHEN s_suppkey % 6 = 0 THEN 'PASSED' END AS f_status,
  CASE WHEN s_suppkey % 5 = 0 THEN 50000.0 END AS f_min, CASE WHEN s_suppkey % 5 = 0 THEN 250000.0 END AS f_max
  FROM supplier)"""
VENDOR = f"""
asked AS (SELECT s_suppkey AS query_id, NULL AS q,
  CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE {pick('s_suppkey', _SUPP_WORD)} END AS vendor, NULL AS f_currency,
  NULL AS f_status, NULL AS f_min, NULL AS f_max FROM supplier)"""

MATCH = f"""
asked_words AS (
  SELECT query_id, 'q' AS part, unnest(string_split_regex(lower(q), '\\s+')) AS word,
    unnest(range(1, len(string_split_regex(lower(q), '\\s+')) + 1)) AS i FROM asked WHERE q IS NOT NULL
  UNION ALL SELECT query_id, 'vendor', unnest(string_split_regex(lower(vendor), '\\s+')),
    unnest(range(1, len(string_split_regex(lower(vendor), '\\s+')) + 1)) FROM asked WHERE vendor IS NOT NULL),
asked_tokens AS (SELECT query_id, part, word, i, unnest({index_tokens('word')}) AS tok,
  unnest(range(1, len({index_tokens('word')}) + 1)) AS j FROM asked_words),
units AS (SELECT query_id, part || '.' || i || '.' || j AS unit, part, word, {stem('tok')} AS tok FROM asked_tokens),
terms AS (
  SELECT query_id, unit, 'vendor_name' AS field, tok AS term FROM units
  UNION ALL SELECT query_id, unit, 'buyer_name', tok FROM units WHERE part = 'q'
  UNION ALL SELECT query_id, unit, 'raw_text', tok FROM units WHERE part = 'q'
  UNION ALL SELECT query_id, unit, 'invoice_number', word FROM units WHERE part = 'q'),
needed AS (SELECT query_id, count(DISTINCT unit) AS n_units FROM units GROUP BY 1),
dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
unit_hits AS (SELECT query_id, unit, p.* FROM terms JOIN postings p USING (field, term)),
matched AS (SELECT query_id, doc_id FROM unit_hits JOIN needed USING (query_id)
  GROUP BY query_id, doc_id, n_units HAVING count(DISTINCT unit) = n_units),
fitting AS (SELECT m.query_id, m.doc_id FROM matched m JOIN asked USING (query_id) JOIN records r ON r.id = m.doc_id
  WHERE (f_currency IS NULL OR f_currency = currency) AND (f_status IS NULL OR f_status = validation_status)
  AND (f_min IS NULL OR total_amount >= f_min) AND (f_max IS NULL OR total_amount <= f_max)),
hits AS (SELECT DISTINCT query_id, doc_id, field, term, tf, len FROM unit_hits JOIN fitting USING (query_id, doc_id)),
lengths AS (SELECT field, sum(tf) / (SELECT count(*) FROM records) AS avg_len FROM postings GROUP BY 1),
bm AS (SELECT query_id, doc_id, floor(sum((ln((SELECT count(*) FROM records) / (df + 1)) + 1) * tf * ({fixed.BM25_K1} + 1)
  / (tf + {fixed.BM25_K1} * (1 - {fixed.BM25_B} + {fixed.BM25_B} * len / avg_len))) * 1000000.0 + 0.5) / 1000000.0 AS score
  FROM hits JOIN dfs USING (field, term) JOIN lengths USING (field) GROUP BY ALL),
wordless AS (SELECT query_id, id AS doc_id, CAST(0 AS DOUBLE) AS score FROM asked JOIN records ON
  (f_currency IS NULL OR f_currency = currency) AND (f_status IS NULL OR f_status = validation_status)
  AND (f_min IS NULL OR total_amount >= f_min) AND (f_max IS NULL OR total_amount <= f_max)
  WHERE query_id NOT IN (SELECT query_id FROM needed)),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, score FROM bm UNION ALL SELECT * FROM wordless))"""

_HITS = "id, filename, invoice_number, invoice_date, vendor_name, buyer_name, currency, detected_language, validation_status, total_amount"
SEARCHED = RECORDS + f""",
plain_texts AS (SELECT key + 1 AS id, vendor_name, buyer_name, invoice_number, text FROM rendered)"""
_FULL = SEARCHED.replace(FACTS, TEXTS, 1) + "," + _postings([
    ("vendor_name", "plain_texts", "vendor_name"), ("buyer_name", "plain_texts", "buyer_name"),
    ("invoice_number", "plain_texts", "invoice_number"), ("raw_text", "plain_texts", "text")])
_VENDOR_ONLY = RECORDS + "," + _postings([("vendor_name", "records", "vendor_name")])


def _check(groups: list[str], kinds: list[str]) -> str:
    return _with(KNOWN + "," + _with_days("known"),
                 f"SELECT id, {', '.join(f'{_joined(groups, k)} AS {k}' for k in kinds)} FROM days")


def _extract(*columns: str) -> str:
    return _with(EXTRACTED, f"SELECT doc_id, {', '.join(columns)} FROM graded")


def _raw_amounts() -> str:
    plain = cents_text("subtotal_c", "''")
    foreign = f"translate({plain}, '{fixed.ASCII_DIGITS[:10]}', '{fixed.FOREIGN_DIGITS[:10]}')"
    return _with_cte(FACTS, f"""
raws AS (SELECT key, CASE key % 6 WHEN 0 THEN {cents_text('subtotal_c', 'sym')} WHEN 1 THEN translate({plain}, ',.', '.,')
  WHEN 2 THEN replace({plain}, ',', '') WHEN 3 THEN '  ' || replace({plain}, ',', ' ') || '  ' WHEN 4 THEN {foreign}
  ELSE CASE WHEN key % 12 = 5 THEN '' ELSE '5-3' END END AS raw FROM facts)""")


def _with_cte(base: str, more: str) -> str:
    return f"{base},{more}"


_RAW_DATE_SHAPES = ["%Y-%m-%d", "%d/%m/%Y", "%-d/%-m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%B %-d, %Y",
                    "%b %-d, %Y", "%-d %B %Y", "%d %b %Y", "%Y%m%d", "%d/%m/%y"]
_RAW_DATES = _with_cte(FACTS, f"""
raws AS (SELECT key, CASE key % 14 {' '.join(f"WHEN {i} THEN strftime(invoice_day, '{s}')" for i, s in enumerate(_RAW_DATE_SHAPES))}
  ELSE 'no date' END AS raw FROM facts),
clean_raws AS (SELECT *, {squeeze(ascii_digits('raw'))} AS c FROM raws)""")

_ALL_MATCH = " || ".join(
    f"list_transform(regexp_extract_all(t, {lit(p)}, 1), lambda x: trim(x))" for p in [*fixed.CURRENCY_PATTERNS, *fixed.DUE_PATTERNS])
_BADGE = ("CASE WHEN score IS NULL THEN '' ELSE (CASE WHEN score >= 0.85 THEN 'High' WHEN score >= 0.60 THEN 'Med' ELSE 'Low' END) "
          "|| ' ' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%' END")


_MERGE = RECORDS.replace(FACTS, TEXTS, 1) + f""",
sides AS (SELECT r.id, r.id - 1 AS k, r.filename, r.invoice_number, r.total_amount, r.validation_status, r.stamp, x.file_hash
  FROM records r JOIN texts x ON x.doc_id = r.id),
target AS (SELECT * FROM sides WHERE k % 4 <> 0),
deliveries AS (SELECT filename, invoice_number, total_amount, validation_status, file_hash, 1 AS seq FROM sides WHERE k % 4 = 0
  UNION ALL SELECT filename, invoice_number, NULL, 'RECHECK', file_hash, 2 FROM sides WHERE k % 10 = 0),
last AS (SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY seq DESC) = 1),
fresh AS (SELECT file_hash, (SELECT max(id) FROM target) + row_number() OVER (ORDER BY file_hash) AS new_id
  FROM last WHERE file_hash NOT IN (SELECT file_hash FROM target)),
merged AS (
  SELECT t.id, t.file_hash, coalesce(l.filename, t.filename) AS filename, coalesce(l.invoice_number, t.invoice_number) AS invoice_number,
    CASE WHEN l.file_hash IS NULL THEN t.total_amount ELSE l.total_amount END AS total_amount,
    coalesce(l.validation_status, t.validation_status) AS validation_status, t.stamp AS processed_at
  FROM target t LEFT JOIN last l USING (file_hash)
  UNION ALL SELECT new_id, f.file_hash, filename, invoice_number, total_amount, validation_status, '2026-01-01 00:00:00'
  FROM fresh f JOIN last USING (file_hash))"""

_STREAM = PROCESSED.replace("good AS (SELECT * FROM processed WHERE", f"""
intake AS (SELECT * FROM processed UNION ALL SELECT * REPLACE ('again_' || regexp_replace(filename, '\\.[a-z]+\\z', '.pdf') AS filename)
  FROM processed WHERE key % 10 = 0),
supported AS (SELECT * FROM intake WHERE {_SUPPORTED}),
good AS (SELECT * FROM supported QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY filename LIKE 'again%' DESC) = 1),
unused AS (SELECT * FROM processed WHERE""", 1)


def all_sql() -> dict[str, str]:
    sql = {
        "supported_file_filter": _with(FACTS, f"SELECT key, filename, {_EXTENSION} AS extension, {_SUPPORTED} AS supported FROM facts"),
        "content_hash": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
        "list_recent": _with(RECORDS, f"SELECT {_VIEW} FROM records r ORDER BY r.processed_at DESC, id DESC LIMIT {fixed.RECENT_ROWS}"),
        "render_invoice_text": _with(TEXTS, f"SELECT doc_id, filename, file_hash, text, {_STAMP.format('received_at')} AS received_at FROM texts"),
        "page_text": _with(PAGES, f"SELECT doc_id, page_no, text, {_R6} FROM engine_a"),
        "page_text_alt": _with(PAGES, f"SELECT doc_id, page_no, text, {_R6} FROM engine_b"),
        "ocr_fallback": _with(PAGES, f"SELECT doc_id, page_no, text, {_R6}, engine FROM chosen"),
        "assemble_documents": _with(PAGES + f""",
firsts AS (SELECT doc_id, arg_min(text, page_no) AS text FROM chosen GROUP BY 1)""" + "," + _language("firsts"),
            """SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text, count(*) AS pages,
  floor(avg(conf) * 10000.0 + 0.5) / 10000.0 AS ocr_confidence, arg_max(engine, page_no) AS ocr_engine, any_value(lang_code) AS lang_code
FROM chosen JOIN lang_codes USING (doc_id) GROUP BY doc_id"""),
        "normalize_whitespace": f"SELECT doc_id, {squeeze('text')} AS text FROM documents",
        "clean_text": f"SELECT doc_id, {squeeze(f'''regexp_replace(text, {lit(fixed.CONTROL)}, '', 'g')''')} AS text FROM documents",
        "strip_control": f"SELECT doc_id, {squeeze(f'''regexp_replace(text, {lit(fixed.CONTROL)}, '', 'g')''')} AS text FROM documents",
        "parse_amount": _with(_raw_amounts(), f"SELECT key, raw, {parse_amount('raw')} AS amount FROM raws"),
        "parse_int": _with(_raw_amounts(), f"SELECT key, raw, TRY_CAST(regexp_replace({ascii_digits('raw')}, '[^0-9]', '', 'g') AS BIGINT) AS number FROM raws"),
        "parse_date": _with(_RAW_DATES, f"SELECT key, raw, {iso(read_date('c'))} AS day FROM clean_raws"),
        "format_date_iso": _with(_RAW_DATES, f"SELECT key, raw, coalesce({iso(read_date('c'))}, raw) AS iso FROM clean_raws"),
        "confidence_labels": _with(KNOWN, "SELECT id, field, score, CASE WHEN score >= 0.85 THEN 'High' WHEN score >= 0.60 THEN 'Medium' "
            "WHEN score >= 0.35 THEN 'Low' ELSE 'Very Low' END AS label FROM (" + " UNION ALL ".join(
                f"SELECT id, '{k}' AS field, score_{k} AS score FROM scored" for k in fixed.CONFIDENCE_KEYS) + ")"),
        "confidence_badges": _with(KNOWN, f"""SELECT id, score, {_BADGE} AS badge, percent,
  CASE WHEN percent >= 85 THEN 'green' WHEN percent >= 60 THEN 'amber' ELSE 'red' END AS colour
FROM (SELECT *, CAST(trunc(coalesce(score, 0) * 100) AS INTEGER) AS percent
  FROM (SELECT id, CASE WHEN key % 10 <> 3 THEN ocr_confidence END AS score FROM scored))"""),
        "report_json": _with(VALID, f"SELECT id, {_REPORT} AS report, {_score_json()} AS scores FROM validated"),
        "first_match": _with(EXTRACTED, f"SELECT doc_id, {first_match('t', fixed.NUMBER_PATTERNS)} AS hit FROM lined"),
        "all_matches": _with(EXTRACTED, f"""SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS hits
FROM (SELECT doc_id, {_ALL_MATCH} AS a FROM lined)"""),
        "extract_invoice_number": _extract("invoice_number", "score_invoice_number"),
        "extract_invoice_date": _extract("invoice_date", "score_invoice_date"),
        "extract_due_date": _extract("due_date", "score_due_date"),
        "extract_total": _extract("total_amount", "score_total_amount"),
        "extract_subtotal": _extract("subtotal", "score_subtotal"),
        "extract_tax": _extract("tax_amount", "tax_rate", "score_tax_amount"),
        "extract_discount": _extract("discount"),
        "extract_parties": _extract("vendor_name", "buyer_name", "score_vendor_name", "score_buyer_name"),
        "extract_parties_by_entities": _with(FACTS + """,
named AS (
  SELECT key + 1 AS doc_id, list_concat(CASE WHEN v.s_suppkey IS NOT NULL THEN [vendor_name] ELSE []::VARCHAR[] END,
    CASE WHEN b.c_custkey IS NOT NULL THEN [buyer_name] ELSE []::VARCHAR[] END) AS names
  FROM facts LEFT JOIN supplier v ON vendor_name = 'vendor ' || v.s_suppkey
    LEFT JOIN customer b ON buyer_name = 'buyer ' || b.c_custkey)""",
            f"""SELECT doc_id, coalesce(names[1], '') AS vendor_name, coalesce(names[2], '') AS buyer_name,
  CASE WHEN len(names) > 0 THEN {fixed.CONF_MEDIUM} ELSE {fixed.CONF_LOW} END::DOUBLE AS score_vendor_name,
  CASE WHEN len(names) > 1 THEN {fixed.CONF_MEDIUM} ELSE {fixed.CONF_LOW} END::DOUBLE AS score_buyer_name FROM named"""),
        "extract_tax_id": _extract("tax_id", "score_tax_id"),
        "extract_po_number": _extract("po_number", "score_po_number"),
        "extract_address": _extract("address", "score_address"),
        "extract_currency": _extract("currency", "score_currency"),
        "extract_payment_terms": _extract("payment_terms", "score_payment_terms"),
        "extract_fields": _with(PROCESSED, f"SELECT doc_id, {_FIELDS}, {_score_json()} AS scores, avg_field_confidence FROM processed"),
        "document_languages": _with(_trigram_model(), f"""SELECT doc_id, CASE WHEN length({stripped('text')}) < {fixed.MIN_DETECT_LENGTH} THEN 'en'
  ELSE coalesce(CASE WHEN {script_code('text')} = 'zh' AND regexp_matches(text, {lit(fixed.KANA)}) THEN 'ja' END,
    nullif({script_code('text')}, ''), nullif(detected, ''), 'en') END AS lang_code FROM documents JOIN profile USING (doc_id)"""),
        "extraction_accuracy": _with(FACTS, "SELECT field, CAST(key % 7 AS BIGINT) AS template, count(*) AS n, count(*) AS n_right FROM facts, "
            f"(VALUES {', '.join(f'({lit(f)})' for f in fixed.CHECKED_FIELDS)}) v(field) GROUP BY ALL"),
        "detect_language": _with(TEXTS + "," + _language("texts"), "SELECT doc_id, lang_code FROM lang_codes"),
        "detect_script": _with(TEXTS, f"SELECT doc_id, coalesce(nullif({script_code('text')}, ''), 'en') AS lang_code FROM texts"),
        "language_profile": _with(_trigram_model(), "SELECT doc_id, lang, detected, score, n_grams FROM profile"),
        "language_accuracy": _with(_trigram_model(), f"SELECT lang, detected, count(*) AS n FROM profile WHERE {_slice('doc_id')} >= {1000 - languages.HELD_OUT} GROUP BY ALL"),
        "language_names": f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS code FROM documents)
SELECT doc_id, code, CASE code {' '.join(f"WHEN '{c}' THEN {lit(n)}" for c, n in fixed.LANGUAGE_NAMES.items())}
  ELSE 'Unknown (' || code || ')' END AS name FROM c""",
        "check_mandatory": _check(["mandatory"], KINDS),
        "check_invoice_number": _check(["number"], KINDS),
        "check_dates": _check(["dates"], KINDS),
        "check_amounts": _check(["amounts"], KINDS),
        "check_currency": _check(["currency"], KINDS),
        "check_strict": _check(["strict"], ["warnings"]),
        "validate_invoices": _with(VALID, "SELECT id, validation_status, "
            + ", ".join(f"coalesce(array_to_string({k}, '; '), '') AS {k}" for k in KINDS) + ", is_duplicate FROM validated"),
        "validation_counts": _with(VALID, "SELECT id, validation_status, " + ", ".join(f"len({k}) AS n_{k}" for k in KINDS) + " FROM validated"),
        "flag_duplicates": _with(KNOWN + "," + _duplicates("known"), "SELECT id, invoice_number, is_duplicate, duplicate_of FROM flagged"),
        "duplicates_vs_history": _with(KNOWN, """SELECT id, invoice_number, (SELECT min(h.id) FROM known h WHERE h.key % 10 <> 0
  AND h.invoice_number = b.invoice_number) AS duplicate_of FROM known b WHERE key % 10 = 0 AND invoice_number <> ''
  AND invoice_number IN (SELECT invoice_number FROM known WHERE key % 10 <> 0)"""),
        "invoice_records": _with(RECORDS, f"SELECT {_VIEW} FROM records"),
        "export_projection": _with(RECORDS, f"SELECT {_VIEW.replace('po_number', 'CAST(NULL AS VARCHAR) AS po_number')} FROM records"),
        "invoice_by_id": _with(RECORDS, f"SELECT {_VIEW} FROM records WHERE id = (SELECT max(l_orderkey) + 1 FROM lineitem)"),
        "batch_result_view": _with(PROCESSED, f"""SELECT filename, coalesce(validation_status, '—') AS status,
  coalesce(invoice_number, '') AS invoice_no, coalesce(vendor_name, '') AS vendor, coalesce({money_text('total_amount')}, '') AS total,
  coalesce(currency, '') AS currency, coalesce(detected_language, '') AS language,
  CAST(floor(ocr_confidence * 100 + 0.5) AS BIGINT) || '%' AS ocr_conf, coalesce(error, '') AS error, success FROM results"""),
        "results_view": _with(RECORDS, f"""SELECT {', '.join(fixed.DISPLAY_COLUMNS[:-1])}, stamp AS processed_at,
  CASE validation_status WHEN 'PASSED' THEN 'status-passed' WHEN 'FAILED' THEN 'status-failed' ELSE 'status-warning' END AS status_class FROM records"""),
        "failed_invoices": _with(RECORDS, "SELECT id, filename, invoice_number, vendor_name, total_amount FROM records WHERE validation_status = 'FAILED'"),
        "warning_invoices": _with(RECORDS, "SELECT id, filename, invoice_number, vendor_name FROM records WHERE validation_status = 'WARNING'"),
        "passed_invoices": _with(RECORDS, "SELECT id, filename, invoice_number, invoice_date, vendor_name, total_amount FROM records WHERE validation_status = 'PASSED'"),
        "duplicate_invoices": _with(RECORDS, "SELECT id, filename, invoice_number, vendor_name FROM records WHERE is_duplicate"),
        "by_language": _with(KNOWN, "SELECT detected_language, count(*) AS n FROM known GROUP BY 1"),
        "by_validation_status": _with(RECORDS, "SELECT validation_status, count(*) AS n FROM records GROUP BY 1"),
        "totals_by_currency": _with(KNOWN, f"SELECT currency, count(*) AS n, coalesce(CAST(sum({_c('total_amount')}) AS BIGINT), 0) / 100 AS total FROM known GROUP BY 1"),
        "analytics_summary": _with(RECORDS, f"""SELECT count(*) AS total_invoices,
  (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT detected_language AS k, count(*) AS n FROM records GROUP BY 1)) AS by_language,
  (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT validation_status AS k, count(*) AS n FROM records GROUP BY 1)) AS by_validation_status,
  floor(CAST(sum(floor(avg_field_confidence * 10000 + 0.5)) AS BIGINT) / count(*) / 10000 * 1000 + 0.5) / 1000 AS avg_confidence,
  CAST(sum({_c('total_amount')}) AS BIGINT) / 100 AS total_amount_processed, count(*) FILTER (is_duplicate) AS duplicate_count,
  count(DISTINCT detected_language) AS languages FROM records"""),
        "status_summary": _with(RECORDS, f"""SELECT count(*) AS total, count(*) FILTER (validation_status = 'PASSED') AS passed,
  count(*) FILTER (validation_status = 'WARNING') AS warning, count(*) FILTER (validation_status = 'FAILED') AS failed
FROM records"""),
        "avg_confidence": _with(KNOWN, "SELECT id, avg_field_confidence FROM scored"),
        "batch_summary": _with(PROCESSED, "SELECT count(*) FILTER (success) AS succeeded, count(*) AS total FROM results"),
        "latency_stats": """
WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, median(value) AS md, min(value) AS min, max(value) AS max
  FROM events WHERE value IS NOT NULL GROUP BY 1), b AS (SELECT m AS base FROM s WHERE event_type = 'view')
SELECT event_type, n, floor(m * 10000 + 0.5) / 10000 AS mean, floor(md * 10000 + 0.5) / 10000 AS median, min, max,
  floor(base / m * 10000 + 0.5) / 10000 AS speedup, floor((1 - m / base) * 100 * 100 + 0.5) / 100 AS gain_percent,
  (1 - m / base) * 100 >= 40 AS target_met FROM s, b""",
        "validation_errors": _with(RECORDS, "SELECT id, filename, unnest(errors) AS error FROM records"),
        "error_frequency": _with(RECORDS, "SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM records) GROUP BY 1"),
        "language_distribution": _with(KNOWN, "SELECT detected_language, count(*) AS n FROM known GROUP BY 1 ORDER BY n DESC, 1"),
        "export_preview": _with(RECORDS, f"SELECT {_VIEW} FROM records r ORDER BY r.processed_at DESC, id DESC LIMIT {fixed.PREVIEW_ROWS}"),
        "search_facets": _with(RECORDS, f"SELECT {_HITS} FROM records WHERE currency = 'EUR' AND detected_language = 'de' AND validation_status = 'PASSED'"),
        "search_amount_range": _with(RECORDS, f"SELECT {_HITS} FROM records WHERE total_amount BETWEEN 50000 AND 100000"),
        "search_keyword_scan": _with(SEARCHED.replace(FACTS, TEXTS, 1), f"""SELECT {', '.join('r.' + c for c in _HITS.split(', '))}
FROM records r JOIN plain_texts p USING (id) WHERE contains(lower(r.vendor_name), 'lantern') AND (contains(lower(text), 'part 17')
  OR contains(lower(r.vendor_name), 'part 17') OR contains(lower(r.buyer_name), 'part 17') OR contains(lower(r.invoice_number), 'part 17'))"""),
        "search_scan": _with(SEARCHED.replace(FACTS, TEXTS, 1), f"""SELECT {', '.join('r.' + c for c in _HITS.split(', '))}
FROM records r JOIN plain_texts p USING (id) WHERE currency = 'EUR' AND total_amount >= 100000 AND (contains(lower(text), 'gmbh')
  OR contains(lower(r.vendor_name), 'gmbh') OR contains(lower(r.buyer_name), 'gmbh') OR contains(lower(r.invoice_number), 'gmbh'))
ORDER BY r.id LIMIT 100"""),
        "vendor_scan_batch": _with(KNOWN + "," + VENDOR, f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, vendor_name, invoice_number
FROM (SELECT query_id, id, vendor_name, invoice_number, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank
  FROM asked JOIN known ON contains(lower(vendor_name), lower(vendor))) WHERE rank <= {fixed.BATCH_SEARCH_LIMIT}"""),
        "word_requests": _with(_word_requests(), "SELECT * FROM answers"),
        "tokenize": f"""WITH t AS (SELECT doc_id, {index_tokens('text')} AS ws FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(0, len(ws))) AS INTEGER) AS pos, unnest(ws) AS token FROM t)
SELECT doc_id, pos, token, {stem('token')} AS term FROM u""",
        "build_postings": "WITH rows_ AS (SELECT doc_id AS id, text FROM documents)," + _postings([("raw_text", "rows_", "text")])
            + " SELECT field, term, doc_id, tf, len FROM postings",
        "update_postings": "WITH rows_ AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN text || ' revised editions' ELSE text END AS text "
            "FROM documents)," + _postings([("raw_text", "rows_", "text")]) + " SELECT field, term, doc_id, tf, len FROM postings",
        "fulltext_match": _with(_FULL + "," + MIXED + "," + MATCH, "SELECT query_id, doc_id, count(*) AS n_hits FROM hits GROUP BY ALL"),
        "bm25_scores": _with(_FULL + "," + MIXED + "," + MATCH, "SELECT query_id, doc_id, score FROM bm"),
        "search_topk": _with(_FULL + "," + MIXED + "," + MATCH, f"SELECT query_id, rank, score, {_HITS} FROM placed JOIN records ON id = doc_id WHERE rank <= 10"),
        "vendor_search_batch": _with(_VENDOR_ONLY + "," + VENDOR + "," + MATCH,
            f"SELECT query_id, rank, score, {_HITS} FROM placed JOIN records ON id = doc_id WHERE rank <= {fixed.BATCH_SEARCH_LIMIT}"),
        "upsert_by_hash": _with(_MERGE, "SELECT * FROM merged"),
        "export_csv": _with(RECORDS, f"""SELECT {', '.join(f"nullif({c}, '') AS {c}" if c in _CSV_TEXT else c for c in _RECORD.split(', ')).replace(
            'is_duplicate', "CASE WHEN is_duplicate THEN 'True' ELSE 'False' END AS is_duplicate")}, stamp AS processed_at FROM records"""),
        "export_json": _with(RECORDS, f"SELECT {_VIEW} FROM records"),
        "export_both": _with(KNOWN, "SELECT f AS format, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM known, (VALUES ('csv'), ('json')) v(f) GROUP BY 1"),
        "process_documents": _with(PROCESSED, f"SELECT doc_id, filename, file_hash, success, error, ocr_engine, ocr_confidence, {_FIELDS}, "
            "avg_field_confidence, validation_status, is_duplicate, report FROM results"),
        "quarantine": _with(PROCESSED, "SELECT doc_id, filename, error FROM results WHERE NOT success"),
        "stream_intake": _with(_STREAM, "SELECT file_hash, filename, invoice_number, total_amount, "
            "CASE WHEN len(errors) > 0 THEN 'FAILED' WHEN len(list_filter(warnings, lambda w: NOT starts_with(w, 'Duplicate'))) > 0 "
            "THEN 'WARNING' ELSE 'PASSED' END AS validation_status, is_duplicate FROM validated"),
        "stream_dedup": _with(TEXTS, "SELECT doc_id, file_hash FROM texts UNION ALL SELECT doc_id, file_hash FROM texts WHERE key % 10 = 1"),
    }
    return sql


_CSV_TEXT = {"filename", "invoice_number", "invoice_date", "due_date", "vendor_name", "buyer_name", "currency", "tax_id",
             "po_number", "address", "payment_terms", "detected_language"}
