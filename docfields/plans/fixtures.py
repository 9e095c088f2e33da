"""Invoice-shaped inputs derived from the star-schema tables.

The same SQL text feeds Spark (tables as parameters) and the oracle (tables as views), so both
sides see the same rows: integer cents, text and integer geometry only, no floating point.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Twenty surnames, ten characters each.
SURNAMES = "".join(
    name.ljust(10)
    for name in """
    Tran Hurst Rodgers Mendoza Fuller Martin Hays Andrade Kim Hood
    Clark Johnson Stephens Patel Garcia Nguyen Miller Lopez Brown Davis
    """.split()
)


def surname(n: str) -> str:
    return f"trim(substr('{SURNAMES}', CAST(10 * (({n}) % 20) + 1 AS INT), 10))"


def party(key: str) -> str:
    """A firm's name; the pattern turns with the key."""
    a, b, c = surname(key), surname(f"{key} + 7"), surname(f"{key} + 13")
    return (
        f"CASE ({key}) % 4 WHEN 0 THEN {a} || '-' || {b} WHEN 1 THEN {a} || ', ' || {b} || ' and ' || {c} "
        f"WHEN 2 THEN {a} || ' and Sons' ELSE {a} || ' Inc' END"
    )


def whole(cents: str) -> str:
    return f"CAST(({cents} - {cents} % 100) / 100 AS BIGINT)"


def plain(cents: str) -> str:
    """1140.24"""
    return f"(CAST({whole(cents)} AS STRING) || '.' || lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


def european(cents: str) -> str:
    """1 140,24"""
    d = whole(cents)
    t = f"CAST(({d} - {d} % 1000) / 1000 AS BIGINT)"
    m = f"CAST(({d} - {d} % 1000000) / 1000000 AS BIGINT)"
    grouped = (
        f"CASE WHEN {d} >= 1000000 THEN CAST({m} AS STRING) || ' ' || lpad(CAST({t} % 1000 AS STRING), 3, '0') || ' ' || lpad(CAST({d} % 1000 AS STRING), 3, '0') "
        f"WHEN {d} >= 1000 THEN CAST({t} AS STRING) || ' ' || lpad(CAST({d} % 1000 AS STRING), 3, '0') ELSE CAST({d} AS STRING) END"
    )
    return f"({grouped} || ',' || lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


def decimal(column: str, kind: str) -> str:
    return f"CAST({column} AS DECIMAL({kind}))"


LINES = f"""
SELECT l_orderkey AS key, l_linenumber AS line_no, l_suppkey AS supp, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty,
  CAST(round({decimal('l_extendedprice', '12,2')} * (1 - {decimal('l_discount', '4,2')}), 2) * 100 AS BIGINT) AS net_cents,
  CAST({decimal('l_tax', '4,2')} * 100 AS BIGINT) AS rate,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS item
FROM {{lineitem}}
"""

INVOICE = (
    ("key", "o.o_orderkey"), ("invoice_number", "CAST(10000000 + o.o_orderkey AS STRING)"),
    ("invoice_date", "substr(CAST(CAST(o.o_orderdate AS DATE) AS STRING), 1, 10)"),
    ("seller_name", party("s.first_supp")), ("client_name", party("o.o_custkey + 3")),
    ("net_cents", "s.net_cents"), ("tax_cents", "s.tax_cents"), ("total_cents", "s.net_cents + s.tax_cents"), ("items", "s.items"),
    ("file_name", "'inv-' || CAST(o.o_orderkey AS STRING) || '.jpg'"),
)
SUMS = f"""
    CAST(round(sum({decimal('l_extendedprice', '12,2')} * (1 - {decimal('l_discount', '4,2')})), 2) * 100 AS BIGINT) AS net_cents,
    CAST(round(sum({decimal('l_extendedprice', '12,2')} * (1 - {decimal('l_discount', '4,2')}) * {decimal('l_tax', '4,2')}), 2) * 100 AS BIGINT) AS tax_cents,
    min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) % 1000000000 AS first_supp, count(*) AS items
"""

INVOICES = f"""
SELECT {', '.join(f'{c} AS {name}' for name, c in INVOICE)}
FROM {{orders}} o JOIN (SELECT l_orderkey, {SUMS} FROM {{lineitem}} GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey
"""

TRUTH = f"""
SELECT key, file_name, invoice_number, invoice_date, seller_name, client_name,
  {plain('tax_cents')} AS tax, {plain('net_cents')} AS net_worth, {plain('total_cents')} AS total_amount
FROM {{invoices}}
"""

PREDICTIONS = f"""
SELECT key, 'processed_' || file_name AS file_name,
  CASE WHEN key % 19 = 0 THEN NULL ELSE invoice_number END AS invoice_number,
  CASE WHEN key % 7 = 0 THEN NULL WHEN key % 2 = 0 THEN substr(invoice_date, 6, 2) || '/' || substr(invoice_date, 9, 2) || '/' || substr(invoice_date, 1, 4) ELSE invoice_date END AS invoice_date,
  CASE WHEN key % 23 = 0 THEN client_name WHEN key % 3 = 0 THEN upper(replace(seller_name, ' ', '  ')) ELSE seller_name END AS seller_name,
  CASE WHEN key % 29 = 0 THEN 'None' ELSE client_name END AS client_name,
  CASE WHEN key % 7 = 0 THEN '' ELSE {european('tax_cents')} END AS tax,
  CASE WHEN key % 5 = 0 THEN {european('net_cents')} ELSE {plain('net_cents')} END AS net_worth,
  CASE WHEN key % 11 = 0 THEN {plain('net_cents')} WHEN key % 31 = 0 THEN 'n/a' ELSE {plain('total_cents')} END AS total_amount
FROM {{invoices}} WHERE key % 13 <> 0
"""

MANIFEST = """
SELECT key, file_name AS original_file, 'processed_' || file_name AS processed_file, '/raw/' || file_name AS original_path,
  '/clean/processed_' || file_name AS processed_path, CASE WHEN key % 17 = 0 THEN 'failed' ELSE 'success' END AS status
FROM {invoices} WHERE key % 37 <> 0
"""

RAW = f"""
SELECT key, 'batch1_' || CAST(1 + key % 3 AS STRING) || '.csv' AS batch_csv, key AS row_idx, file_name,
  CASE WHEN key % 101 = 0 THEN '{{{{"invoice": broken' ELSE
  '{{{{"invoice": {{{{"client_name": "' || client_name || '", "seller_name": " ' || seller_name || ' ", "invoice_number": "' || invoice_number || '", "invoice_date": "'
  || substr(invoice_date, 6, 2) || '/' || substr(invoice_date, 9, 2) || '/' || substr(invoice_date, 1, 4)
  || '"}}}}, "subtotal": {{{{"tax": "' || CASE WHEN key % 5 = 0 THEN '10%' WHEN key % 103 = 0 THEN 'n/a' ELSE {european('tax_cents')} END
  || '", "total": "$ ' || {european('total_cents')} || '"}}}}}}}}' END AS json_data
FROM {{invoices}}
UNION ALL
SELECT key, 'batch1_3.csv' AS batch_csv, key + 1000000000 AS row_idx, file_name, '{{{{}}}}' AS json_data FROM {{invoices}} WHERE key % 97 = 0
"""

# (line, segment, y, x, words) of a page: what stands once, and what stands for every item
ONCE = [
    ("0", 0, "60", 50, "'Invoice no: ' || invoice_number"),
    ("1", 0, "100", 50, "'Date of issue: ' || substr(invoice_date, 6, 2) || '/' || substr(invoice_date, 9, 2) || '/' || substr(invoice_date, 1, 4)"),
    ("2", 0, "240", 50, "'Seller:'"),
    ("2", 1, "240", 550, "'Client:'"),
    ("3", 0, "280", 50, "seller_name"),
    ("3", 1, "280", 550, "client_name"),
    ("4", 0, "420", 50, "'ITEMS'"),
    ("5", 0, "460", 50, "'No.'"),
    ("5", 1, "460", 110, "'Description'"),
    ("5", 2, "460", 420, "'Qty'"),
    ("5", 3, "460", 500, "'UM'"),
    ("5", 4, "460", 560, "'Net price'"),
    ("5", 5, "460", 670, "'Net worth'"),
    ("5", 6, "460", 780, "'VAT [%]'"),
    ("5", 7, "460", 870, "'Gross worth'"),
    ("6 + items", 0, "500 + 30 * items", 50, "'SUMMARY'"),
    ("7 + items", 0, "530 + 30 * items", 420, "'10%'"),
    ("7 + items", 1, "530 + 30 * items", 500, european("net_cents")),
    ("7 + items", 2, "530 + 30 * items", 670, european("tax_cents")),
    ("7 + items", 3, "530 + 30 * items", 840, european("total_cents")),
]
EACH = [
    (0, 50, "CAST(item AS STRING) || '.'"),
    (1, 110, "'Part ' || CAST(part AS STRING) || ' grade ' || CAST(supp % 7 AS STRING)"),
    (2, 420, "CAST(qty AS STRING) || ',00'"),
    (3, 500, "'each'"),
    (4, 560, european("(1000 + part % 90000)")),
    (5, 670, european("net_cents")),
    (6, 780, "CAST(rate AS STRING) || '%'"),
    (7, 870, european("(net_cents + net_cents % 1000)")),
]


def _cells() -> list[tuple[str, str]]:
    """(table, columns) of every segment."""
    row = "CAST({} AS INT) AS line, {} AS seg, CAST({} AS INT) AS y, {} AS x, {} AS words"
    once = [("invoices", row.format(*c)) for c in ONCE]
    return once + [("lines", row.format("5 + item", seg, "470 + 30 * item", x, words)) for seg, x, words in EACH]


SEGMENTS = "\nUNION ALL ".join(f"SELECT key, {columns} FROM {{{table}}}" for table, columns in _cells())


def _structs(cells) -> str:
    """The same segments as one array of structs for each row, in the order of their lines."""
    return "array(" + ", ".join(f"named_struct('line', CAST({line} AS INT), 'seg', {seg}, 'y', CAST({y} AS INT), 'x', {x}, 'words', {words})" for line, seg, y, x, words in cells) + ")"


SEGMENTS_SPARK = " UNION ALL ".join(f"SELECT key, inline({_structs(cells)}) FROM {{{table}}}" for table, cells in (("invoices", ONCE), ("lines", [("5 + item", seg, "470 + 30 * item", x, words) for seg, x, words in EACH])))

# A page's words as one array.  Its lines and its invoices come together by key once, so words are never shuffled nor ranked; a page
# without an invoice has lines only.
_ORDER = "l_linenumber l_suppkey l_partkey l_quantity l_extendedprice l_discount l_tax l_shipdate l_returnflag l_linestatus".split()
_LINE = f"""named_struct('item', i + 1, 'supp', l.l_suppkey, 'part', l.l_partkey, 'qty', CAST(l.l_quantity AS BIGINT), 'rate', CAST({decimal('l.l_tax', '4,2')} * 100 AS BIGINT),
    'net_cents', CAST(round({decimal('l.l_extendedprice', '12,2')} * (1 - {decimal('l.l_discount', '4,2')}), 2) * 100 AS BIGINT))"""


def _of(name: str, cells) -> str:
    """``_structs`` over fields of the lambda's variable ``v``."""
    fields = {"lines": ("item", "supp", "part", "qty", "rate", "net_cents"), "invoices": [n for n, _ in INVOICE]}[name]
    return re.sub(rf"\b({'|'.join(fields)})\b", r"v.\1", _structs(cells))


PAGES_SPARK = f"""
SELECT key, transform(flatten(transform(segs, s -> flatten(transform(array(split(s.words, ' ')), a -> transform(a, (t, pos) -> named_struct(
    'line', s.line, 'y', s.y, 'text', t, 'x', s.x + if(pos > 0, 8 * (length(array_join(slice(a, 1, pos), ' ')) + 1), 0))))))), (p, i) -> named_struct(
    'word_idx', CAST(i AS BIGINT), 'text', p.text, 'y', CAST(p.y + (i * 7) % 5 AS INT), 'x', CAST(p.x AS INT), 'w', CAST(8 * length(p.text) AS INT), 'h', 16,
    'conf', (key * 31 + i * 17) % 101, 'true_line', p.line)) AS ws
FROM (SELECT key, sort_array(filter(concat(flatten(transform(invoices, v -> {_of("invoices", ONCE)})), flatten(transform(lines, v -> {_of("lines", [("5 + item", seg, "470 + 30 * item", x, words) for seg, x, words in EACH])}))), s -> s.words IS NOT NULL)) AS segs
  FROM (SELECT s.l_orderkey AS key, transform(s.ls, (l, i) -> {_LINE}) AS lines, transform(coalesce(o.os, array()), o -> named_struct({', '.join(f"'{name}', {c}" for name, c in INVOICE)})) AS invoices
    FROM (SELECT l_orderkey, sort_array(collect_list(named_struct({', '.join(f"'{c}', {c}" for c in _ORDER)}))) AS ls, {SUMS} FROM {{lineitem}} GROUP BY l_orderkey) s
    LEFT JOIN (SELECT o_orderkey, collect_list(named_struct('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderdate', o_orderdate)) AS os FROM {{orders}} GROUP BY o_orderkey) o ON o.o_orderkey = s.l_orderkey) j) p
"""

_PLACED = """
SELECT key, word_idx, text, CAST(y + (word_idx * 7) % 5 AS INT) AS y, CAST(x AS INT) AS x, CAST(8 * length(text) AS INT) AS w, 16 AS h,
  (key * 31 + word_idx * 17) % 101 AS conf, line AS true_line
FROM (SELECT key, line, y, x, text, CAST(row_number() OVER (PARTITION BY key ORDER BY line, seg, pos) - 1 AS BIGINT) AS word_idx FROM ({split}) s) p
"""

WORDS_SPARK = "SELECT key, inline_outer(ws) FROM {words_pages}"  # no page is empty, and inline would compute its array twice
WORDS_DUCKDB = _PLACED.replace(
    "{split}",
    "SELECT key, line, seg, y, x + 8 * CAST(coalesce(list_sum([length(t) + 1 FOR t IN string_split(words, ' ')[1:pos]]), 0) AS INT) AS x, string_split(words, ' ')[pos + 1] AS text, pos "
    "FROM (SELECT *, unnest(range(len(string_split(words, ' ')))) AS pos FROM {segments}) u",
)

PARTS = {
    "lines": LINES, "invoices": INVOICES, "truth": TRUTH, "predictions": PREDICTIONS,
    "manifest": MANIFEST, "raw": RAW, "segments": SEGMENTS,
}
NEEDS = {
    "lines": ("lineitem",), "invoices": ("orders", "lineitem"), "truth": ("invoices",), "predictions": ("invoices",), "manifest": ("invoices",),
    "raw": ("invoices",), "segments": ("invoices", "lines"), "words": ("segments",),
}
NEEDS_SPARK = {**NEEDS, "words_pages": ("orders", "lineitem"), "words": ("words_pages",)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` as a Spark plan over the Parquet tables; ``words_pages`` are the words as an array by key."""
    if name not in NEEDS_SPARK:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = {"words": WORDS_SPARK, "words_pages": PAGES_SPARK, "segments": SEGMENTS_SPARK}.get(name) or PARTS[name]
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in NEEDS_SPARK[name]})


def ctes(*names: str) -> str:
    """``WITH`` clause for the oracle that defines ``names`` and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in NEEDS and name not in order:
            for n in NEEDS[name]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    body = [f"{n} AS MATERIALIZED ({(WORDS_DUCKDB if n == 'words' else PARTS[n]).format(**{m: m for m in NEEDS[n]})})" for n in order]
    return "WITH " + ",\n".join(body) + "\n"
