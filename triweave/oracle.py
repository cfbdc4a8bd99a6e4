"""DuckDB SQL of the registered queries, written on its own terms over the same tables."""

OWN = "5242920020"


def canon(x: str) -> str:
    y = f"regexp_replace({x}, '[^A-Za-z0-9]+', '/', 'g')"
    y = rf"regexp_replace(regexp_replace({y}, '([A-Za-z])([0-9])', '\1/\2', 'g'), '([0-9])([A-Za-z])', '\1/\2', 'g')"
    return rf"regexp_replace(trim(upper({y}), '/'), '(^|/)0+([0-9])', '\1\2', 'g')"


def toks(x: str) -> str:
    return f"trim(upper(regexp_replace({x}, '[^A-Za-z0-9]+', '/', 'g')), '/')"


BASE = """inv_base AS (
 SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, CAST(round(o.o_totalprice * 100) AS BIGINT) AS g,
  CAST(5000000000 + o.o_custkey AS VARCHAR) AS nip, c.c_name AS nm,
  CASE c.c_nationkey % 3 WHEN 0 THEN 'PLN' WHEN 1 THEN 'EUR' ELSE 'USD' END AS cur,
  concat(CAST(5000000000 + o.o_custkey AS VARCHAR), '-', strftime(o.o_orderdate, '%Y%m%d'), '-', lpad(CAST(o.o_orderkey AS VARCHAR), 12, '0'), '-AA') AS ref,
  concat('FV/', CAST(o.o_orderkey AS VARCHAR), '/', CAST(year(o.o_orderdate) AS VARCHAR)) AS num
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

FEEDS = f"""{BASE}, inv_mail AS (
 SELECT 'mail' AS source, concat('mail:', k) AS content_hash,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN concat('fv-', lpad(CAST(k AS VARCHAR), 9, '0'), '-', year(d)) WHEN k % 4 = 1 THEN concat('FV', k, '/', year(d)) WHEN k % 4 = 2 THEN concat(num, '/A') ELSE num END AS invoice_number,
  CASE WHEN k % 7 = 0 THEN NULL ELSE nip END AS seller_tax_id, '{OWN}' AS buyer_tax_id, CASE WHEN k % 6 = 0 THEN 'Nabywca' ELSE nm END AS seller_name, d AS issue_date,
  g + (k % 5) - 2 AS gross_amount_minor, cur AS currency, CASE WHEN k % 9 = 0 THEN lower(concat(' ', ref, ' ')) END AS ksef_reference, k AS truth_key
 FROM inv_base WHERE k % 10 NOT IN (1, 2)), inv_ksef AS (
 SELECT 'ksef' AS source, concat('ksef:', ref) AS content_hash, num AS invoice_number, nip AS seller_tax_id, '{OWN}' AS buyer_tax_id, nm AS seller_name, d AS issue_date,
  g AS gross_amount_minor, cur AS currency, ref AS ksef_reference, k AS truth_key FROM inv_base WHERE k % 10 <> 0), inv_saldeo AS (
 SELECT 'saldeo' AS source, concat('saldeo:', k) AS content_hash, CASE WHEN k % 8 = 0 THEN concat('scan_', k, '.pdf') ELSE num END AS invoice_number, nip AS seller_tax_id, CAST(NULL AS VARCHAR) AS buyer_tax_id,
  CASE WHEN k % 5 = 0 THEN 'klient' ELSE nm END AS seller_name, d AS issue_date, g AS gross_amount_minor, cur AS currency, CASE WHEN k % 3 = 0 THEN ref END AS ksef_reference, k AS truth_key
 FROM inv_base WHERE k % 10 NOT IN (2, 3)), feeds AS (SELECT * FROM inv_mail UNION ALL SELECT * FROM inv_ksef UNION ALL SELECT * FROM inv_saldeo)"""

READY = f"""{FEEDS}, ready AS (
 SELECT *, nullif({canon('invoice_number')}, '') AS num, {toks("coalesce(invoice_number, '')")} AS tk, length(regexp_replace(coalesce(invoice_number, ''), '[^A-Za-z0-9]', '', 'g')) AS len, nullif(upper(trim(ksef_reference)), '') AS ref FROM feeds)"""


def points(a: str, b: str) -> str:
    n = lambda t: f"length({t}.tk) - length(replace({t}.tk, '/', ''))"
    has = lambda s, l: f"({s}.tk <> '' AND contains('/' || {l}.tk || '/', '/' || {s}.tk || '/'))"
    inside = f"(CASE WHEN {n(a)} <= {n(b)} THEN {has(a, b)} ELSE {has(b, a)} END AND {a}.num IS NOT NULL AND {b}.num IS NOT NULL)"
    near = f"({a}.gross_amount_minor <> 0 AND {b}.gross_amount_minor <> 0 AND {a}.currency = {b}.currency AND abs({a}.gross_amount_minor - {b}.gross_amount_minor) <= 2)"
    days = f"abs(date_diff('day', {a}.issue_date, {b}.issue_date))"
    return f"""CASE WHEN {a}.ref <> {b}.ref THEN 0 ELSE least(100, CASE WHEN {a}.ref = {b}.ref THEN 100 ELSE 0 END
      + CASE WHEN {a}.num = {b}.num THEN 45 WHEN {inside} AND least({a}.len, {b}.len) >= 8 THEN 45 WHEN {inside} THEN 25 ELSE 0 END
      + CASE WHEN {a}.seller_tax_id = {b}.seller_tax_id THEN 25 ELSE 0 END
      + CASE WHEN {near} AND {a}.gross_amount_minor = {b}.gross_amount_minor THEN 20 WHEN {near} THEN 17 ELSE 0 END
      + CASE WHEN {days} = 0 THEN 10 WHEN {days} <= 7 THEN 4 ELSE 0 END + CASE WHEN {a}.currency = {b}.currency THEN 5 ELSE 0 END) END"""


def kind(a: str, b: str) -> str:
    near = f"({a}.gross_amount_minor <> 0 AND {b}.gross_amount_minor <> 0 AND {a}.currency = {b}.currency AND abs({a}.gross_amount_minor - {b}.gross_amount_minor) <= 2)"
    ident = f"({a}.num = {b}.num AND CASE WHEN {a}.seller_tax_id IS NOT NULL AND {b}.seller_tax_id IS NOT NULL THEN {a}.seller_tax_id = {b}.seller_tax_id ELSE {near} END)"
    return f"CASE WHEN {a}.ref <> {b}.ref THEN NULL WHEN {a}.ref = {b}.ref THEN 0 WHEN {ident} THEN 1 WHEN {points(a, b)} >= 70 THEN 2 END"


def pair(left: str, right: str) -> str:
    return f"SELECT '{left}' AS left_source, a.content_hash AS left_id, '{right}' AS right_source, b.content_hash AS right_id, a.truth_key AS tk, {kind('a', 'b')} AS pass, {points('a', 'b')} AS score FROM ready a JOIN ready b ON a.truth_key = b.truth_key AND a.source = '{left}' AND b.source = '{right}'"


PAIRS = f"{READY}, pairs AS (SELECT * FROM ({pair('mail', 'ksef')} UNION ALL {pair('mail', 'saldeo')} UNION ALL {pair('ksef', 'saldeo')}) WHERE pass IS NOT NULL)"

# No two truth keys meet in these feeds, and no links of one conflict: a row is a connected set of its at most three records.
ROWS = f"""{PAIRS}, l AS (
 SELECT tk, bool_or(left_source = 'mail' AND right_source = 'ksef') AS mk, bool_or(left_source = 'mail' AND right_source = 'saldeo') AS ms, bool_or(left_source = 'ksef' AND right_source = 'saldeo') AS ks FROM pairs GROUP BY tk), n AS (
 SELECT r.source, r.content_hash, r.truth_key, CASE
   WHEN r.source = 'mail' OR (r.source = 'ksef' AND (coalesce(mk, false) OR (coalesce(ms, false) AND coalesce(ks, false)))) OR (r.source = 'saldeo' AND (coalesce(ms, false) OR (coalesce(mk, false) AND coalesce(ks, false)))) THEN 0
   WHEN r.source = 'ksef' OR coalesce(ks, false) THEN 1 ELSE 2 END AS part
 FROM ready r LEFT JOIN l ON r.truth_key = l.tk), g AS (
 SELECT truth_key, part, max(content_hash) FILTER (source = 'mail') AS mail, max(content_hash) FILTER (source = 'ksef') AS ksef, max(content_hash) FILTER (source = 'saldeo') AS saldeo FROM n GROUP BY truth_key, part), rows AS (
 SELECT g.*, CASE WHEN mail IS NOT NULL AND ksef IS NOT NULL AND saldeo IS NOT NULL THEN 'in_all_three' WHEN mail IS NOT NULL AND ksef IS NOT NULL THEN 'gmail_ksef_missing_saldeo' WHEN mail IS NOT NULL AND saldeo IS NOT NULL THEN 'gmail_saldeo_missing_ksef'
   WHEN mail IS NOT NULL THEN 'gmail_only' WHEN ksef IS NOT NULL AND saldeo IS NOT NULL THEN 'ksef_saldeo_missing_gmail' WHEN ksef IS NOT NULL THEN 'ksef_only' ELSE 'saldeo_only' END AS status FROM g)"""

VALID = "(length(trim({0})) >= 3 AND regexp_matches(trim({0}), '[0-9]') AND trim({0}) NOT IN ('ZOSTA','ZOSTAŁA','VAT','FOR','INVOICE','NUMBER','DATE','DUE','FAKTURY','FAKTURA','NUMER','PODSTAWOWA','SYSTEM','KSEF'))"
FILE = "regexp_matches(upper(trim({0})), '[.](PDF|XML|JPG|JPEG|PNG)$')"
CSUM = "(" + " + ".join(f"CAST(substr({{0}}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate((6, 5, 7, 2, 3, 4, 5, 6, 7))) + ") % 11 = CAST(substr({0}, 10, 1) AS INT)"
PRIMARY = "JOIN ready p ON p.content_hash = coalesce(r.mail, r.ksef, r.saldeo)"
JOIN3 = "LEFT JOIN ready m ON m.content_hash = r.mail LEFT JOIN ready k ON k.content_hash = r.ksef LEFT JOIN ready s ON s.content_hash = r.saldeo"
USEFUL = "(length(trim({0})) >= 3 AND regexp_matches({0}, '[A-Za-z]') AND lower(regexp_replace(trim({0}), '[^A-Za-z0-9]', '', 'g')) NOT IN ('nabywca','klient'))"
PARTY = "CASE WHEN lower(trim({0})) NOT IN ('nabywca') THEN trim({0}) END"
NEWNUM = f"CASE WHEN s.invoice_number IS NULL OR {FILE.format('s.invoice_number')} THEN coalesce(CASE WHEN NOT {FILE.format('k.invoice_number')} THEN k.invoice_number END, CASE WHEN NOT {FILE.format('m.invoice_number')} THEN m.invoice_number END, s.invoice_number) ELSE s.invoice_number END"
NEWNAME = f"CASE WHEN {USEFUL.format('s.seller_name')} THEN s.seller_name WHEN {USEFUL.format('k.seller_name')} THEN k.seller_name WHEN {USEFUL.format('m.seller_name')} THEN m.seller_name ELSE s.seller_name END"

ORACLE = {
    "feeds": f"WITH {FEEDS} SELECT source, content_hash, invoice_number, seller_tax_id, buyer_tax_id, seller_name, issue_date, gross_amount_minor, currency, ksef_reference FROM feeds",
    "numbers": f"""WITH {FEEDS} SELECT source, content_hash, {canon('invoice_number')} AS canonical, {toks('invoice_number')} AS tokens, coalesce({VALID.format('invoice_number')}, false) AS valid, {FILE.format('invoice_number')} AS filename,
      upper(replace(regexp_replace(trim(invoice_number), '^[:#.,]+|[:#.,]+$', '', 'g'), '_', '/')) AS cleaned FROM feeds""",
    "identities": f"""WITH {FEEDS} SELECT source, content_hash, {CSUM.format('seller_tax_id')} AS seller_checksum, seller_tax_id AS counterparties, nullif(upper(trim(ksef_reference)), '') AS reference,
      (CASE WHEN ksef_reference IS NULL THEN 0 ELSE 16 END + CASE WHEN invoice_number IS NULL THEN 0 ELSE 8 END + CASE WHEN seller_tax_id IS NULL THEN 0 ELSE 2 END + CASE WHEN buyer_tax_id IS NULL THEN 0 ELSE 2 END + 1 + 2 + 2 + 1) AS completeness FROM feeds""",
    "money": """SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(38,10)) * 100) AS BIGINT) AS minor, CAST(round(CAST(l_extendedprice AS DECIMAL(38,10)) * 100) AS BIGINT) AS local_minor,
      CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(38,10)) * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(38,10)) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS shown FROM lineitem""",
    "dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS alternative, CASE WHEN year(o_orderdate) = 1996 THEN strftime(o_orderdate, '%Y-%m') END AS period FROM orders",
    "dedupe": f"""WITH {FEEDS}, d AS (SELECT * FROM inv_mail UNION ALL SELECT source, content_hash || ':copy', invoice_number, seller_tax_id, buyer_tax_id, NULL, issue_date, gross_amount_minor, currency, ksef_reference, truth_key FROM inv_mail WHERE truth_key % 4 = 3)
      SELECT content_hash FROM d WHERE NOT (content_hash LIKE '%:copy' AND invoice_number IS NOT NULL)""",
    "duplicate_groups": f"""WITH {FEEDS} SELECT invoice_number, count(*) + 1 AS n, max(content_hash) AS kept FROM inv_saldeo WHERE truth_key % 4 = 1 GROUP BY ALL""",
    "candidate_pairs": f"WITH {PAIRS} SELECT left_source, left_id, right_source, right_id, pass, score FROM pairs",
    "tri_rows": f"WITH {ROWS} SELECT r.mail AS mail_id, r.ksef AS ksef_id, r.saldeo AS saldeo_id, status, CASE WHEN r.mail IS NOT NULL AND r.ksef IS NOT NULL THEN {points('m', 'k')} END AS mail_score_to_ksef, CASE WHEN r.mail IS NOT NULL AND r.saldeo IS NOT NULL THEN {points('m', 's')} END AS mail_score_to_saldeo, CASE WHEN r.ksef IS NOT NULL AND r.saldeo IS NOT NULL THEN {points('k', 's')} END AS ksef_score_to_saldeo FROM rows r {JOIN3}",
    "tri_summary": f"WITH {ROWS} SELECT count(mail) AS mail_count, count(ksef) AS ksef_count, count(saldeo) AS saldeo_count, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("in_all_three", "gmail_ksef_missing_saldeo", "gmail_saldeo_missing_ksef", "gmail_only", "ksef_saldeo_missing_gmail", "ksef_only", "saldeo_only")) + " FROM rows",
    "display_records": f"""WITH {ROWS} SELECT r.mail AS mail_id, r.ksef AS ksef_id, r.saldeo AS saldeo_id, coalesce(k.invoice_number, s.invoice_number, m.invoice_number) AS invoice_number, coalesce({PARTY.format('k.seller_name')}, {PARTY.format('m.seller_name')}, {PARTY.format('s.seller_name')}) AS seller_name,
      coalesce(k.seller_tax_id, s.seller_tax_id, m.seller_tax_id) AS seller_tax_id, coalesce(k.gross_amount_minor, s.gross_amount_minor, m.gross_amount_minor) AS gross_amount_minor,
      array_to_string(list_filter([CASE WHEN r.mail IS NOT NULL THEN 'G' END, CASE WHEN r.ksef IS NOT NULL THEN 'K' END, CASE WHEN r.saldeo IS NOT NULL THEN 'S' END], lambda x: x IS NOT NULL), '+') AS mask FROM rows r {JOIN3}""",
    "missing_rows": f"WITH {ROWS} SELECT status, year(p.issue_date) AS year, count(*) AS n, CAST(sum(p.gross_amount_minor) AS BIGINT) AS gross FROM rows r {PRIMARY} WHERE status <> 'in_all_three' GROUP BY ALL",
    "year_filters": f"WITH {FEEDS} SELECT source, year(issue_date) AS year, count(*) AS n, count(*) FILTER (year(issue_date) = 1996) AS in_year, count(seller_tax_id) AS with_id FROM feeds GROUP BY ALL",
    "quarters": f"WITH {FEEDS}, w AS (SELECT y, q, CASE WHEN q = 1 THEN make_date(y, 1, 1) - 1 ELSE make_date(y, 3 * q - 2, 1) END AS a, CASE WHEN q = 4 THEN make_date(y + 1, 1, 2) ELSE make_date(y, 3 * q + 1, 1) END AS b FROM (SELECT DISTINCT CAST(year(issue_date) AS INT) AS y FROM feeds), (SELECT unnest([1, 2, 3, 4]) AS q)) SELECT y AS year, q AS quarter, count(*) AS n FROM w JOIN inv_ksef f ON f.issue_date >= a AND f.issue_date < b GROUP BY ALL",
    "repairs": f"""WITH {ROWS}, x AS (SELECT s.content_hash, s.invoice_number AS oldnum, s.seller_name AS oldname, s.buyer_tax_id AS oldbuyer, {NEWNUM} AS num, {NEWNAME} AS name, coalesce(k.buyer_tax_id, m.buyer_tax_id) AS buyer FROM rows r {JOIN3} WHERE r.saldeo IS NOT NULL)
      SELECT content_hash, CASE WHEN oldnum IS DISTINCT FROM num THEN num ELSE oldnum END AS invoice_number, array_to_string(list_filter([CASE WHEN oldnum IS DISTINCT FROM num AND NOT {FILE.format('num')} THEN 'invoice_number' END, CASE WHEN oldname IS DISTINCT FROM name THEN 'seller_name' END, CASE WHEN oldbuyer IS DISTINCT FROM buyer THEN 'buyer_tax_id' END], lambda v: v IS NOT NULL), ',') AS changed
      FROM x WHERE (oldnum IS DISTINCT FROM num AND NOT {FILE.format('num')}) OR oldname IS DISTINCT FROM name OR oldbuyer IS DISTINCT FROM buyer""",
    "overrides": f"""WITH {FEEDS} SELECT content_hash, CASE WHEN truth_key % 8 = 0 AND truth_key % 16 <> 0 THEN concat('FV/', truth_key, '/', year(issue_date)) ELSE invoice_number END AS invoice_number, truth_key % 8 = 0 AND truth_key % 16 <> 0 AS marked FROM inv_saldeo""",
    "upload_plan": f"""WITH {ROWS}, i AS (SELECT m.*, r.status AS row_status, r.ksef FROM rows r JOIN ready m ON m.content_hash = r.mail WHERE r.saldeo IS NULL)
      SELECT CASE WHEN truth_key % 13 = 0 THEN 'missing_local_file' WHEN truth_key % 17 = 0 THEN 'unconfirmed' WHEN truth_key % 5 = 4 THEN 'already_uploaded' WHEN year(issue_date) = 1996 THEN 'planned' ELSE 'other_year' END AS upload_status, row_status AS status, content_hash, CASE WHEN ksef IS NULL THEN 'mail' ELSE 'mail+ksef' END AS related,
       CASE WHEN truth_key % 13 = 0 THEN NULL WHEN truth_key % 17 = 0 OR truth_key % 5 = 4 THEN 1995 WHEN year(issue_date) = 1996 THEN 1996 END AS period_year FROM i""",
    "upload_summary": f"""WITH {ROWS}, i AS (SELECT CASE WHEN m.truth_key % 13 = 0 THEN 'missing' WHEN m.truth_key % 17 = 0 THEN 'unconfirmed' WHEN m.truth_key % 5 = 4 THEN 'already' WHEN year(issue_date) = 1996 THEN 'planned' ELSE 'other' END AS u FROM rows r JOIN (SELECT * EXCLUDE (source) FROM ready) m ON m.content_hash = r.mail WHERE r.saldeo IS NULL)
      SELECT count(*) AS total_missing_ledger, count(*) FILTER (u = 'planned') AS uploadable_count, count(*) FILTER (u = 'missing') AS missing_file_count, count(*) FILTER (u = 'already') AS already_uploaded_count, count(*) FILTER (u = 'unconfirmed') AS unconfirmed_count, count(*) FILTER (u = 'other') AS other_year_count, 0 AS uploaded_count, 0 AS failed_count FROM i""",
    "approve_plan": f"""WITH {ROWS}, d AS (SELECT r.truth_key AS document_id, bool_or(r.mail IS NOT NULL) AS has_mail FROM rows r WHERE r.saldeo IS NOT NULL AND r.ksef IS NOT NULL AND r.truth_key % 2 = 0 GROUP BY 1)
      SELECT document_id, has_mail, CASE WHEN NOT has_mail THEN 'skipped' WHEN (SELECT count(*) FROM d WHERE has_mail) > 1000000 THEN 'blocked' ELSE 'pending' END AS decision FROM d""",
    "snapshot_diff": f"WITH {FEEDS} SELECT count(*) FILTER (truth_key % 10 IN (2, 3)) AS added, count(*) FILTER (truth_key % 10 = 0) AS removed, count(*) FILTER (truth_key % 10 NOT IN (0, 2, 3) AND truth_key % 8 = 0) AS changed FROM (SELECT truth_key FROM inv_ksef UNION SELECT truth_key FROM inv_saldeo)",
    "upsert": f"WITH {FEEDS} SELECT source, content_hash, CASE WHEN truth_key % 2 = 0 THEN gross_amount_minor + 1 ELSE gross_amount_minor END AS gross_amount_minor, truth_key % 2 = 0 AS updated FROM inv_mail WHERE truth_key % 3 <> 0 OR truth_key % 2 = 0",
    "store_stats": f"WITH {FEEDS} SELECT source, count(*) AS n, CAST(sum(gross_amount_minor) AS BIGINT) AS gross, min(issue_date) AS first_day, max(issue_date) AS last_day FROM feeds GROUP BY source",
    "latest_records": f"WITH {FEEDS} SELECT content_hash, issue_date FROM inv_ksef ORDER BY issue_date DESC, content_hash DESC LIMIT 100",
    "rate_audit": """WITH e AS (SELECT user_id AS grp, epoch_ms(ts) AS t FROM events), w AS (SELECT grp, t,
       count(*) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) AS u1, count(*) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS u2, count(*) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS u3,
       lag(t, 7) OVER (PARTITION BY grp ORDER BY t) AS a1, lag(t, 15) OVER (PARTITION BY grp ORDER BY t) AS a2, lag(t, 19) OVER (PARTITION BY grp ORDER BY t) AS a3 FROM e)
       SELECT grp AS "group", count(*) AS n, max(u1) AS used_1s, max(u2) AS used_60s, max(u3) AS used_1h, CAST(sum(coalesce(greatest(CASE WHEN u1 >= 8 THEN greatest(0, a1 + 1000 - t) END, CASE WHEN u2 >= 16 THEN greatest(0, a2 + 60000 - t) END, CASE WHEN u3 >= 20 THEN greatest(0, a3 + 3600000 - t) END), 0)) AS BIGINT) AS wait_ms FROM w GROUP BY grp""",
}
