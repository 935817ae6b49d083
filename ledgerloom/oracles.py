"""DuckDB SQL for the registered queries, written from their definitions and not from the DataFrame code."""

from __future__ import annotations

from ledgerloom.spoiled import CASES


def money(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


def percent(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <= 0 THEN 'n/a' ELSE CAST((100 * {a}) // ({b}) AS VARCHAR) || '%' END"


def cents(c: str) -> str:
    return f"(CAST(ceil({c} / 10000) AS BIGINT) * 1000000 - CAST(ceil({c} / 10000) AS BIGINT) * 37 % 100)"


BASE = """
WITH inv AS (
  SELECT 'S-' || c_custkey AS scenario_id, o_orderkey AS pos, 'INV-' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS date,
    CAST(o_orderdate AS DATE) + CAST(30 + 15 * (c_nationkey % 3) AS INTEGER) AS due, """ + cents("o_totalprice") + """ AS cents, o_orderpriority AS memo
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) <= DATE '2000-06-30'
), client AS (
  SELECT 'S-' || c_custkey AS scenario_id, CASE c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS pool, 'CL-' || c_custkey AS client_id, c_name AS name,
    CAST(30 + 15 * (c_nationkey % 3) AS INTEGER) AS terms_days, DATE '2000-06-30' AS as_of, c_custkey
  FROM customer WHERE 'S-' || c_custkey IN (SELECT scenario_id FROM inv)
), line AS (
  SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) AS pos FROM lineitem
), src AS (
  SELECT inv.scenario_id, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'credit_memo' ELSE 'payment' END AS kind, line.pos,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'CM-' ELSE 'PMT-' END || line.pos AS id, greatest(CAST(l_shipdate AS DATE), inv.date) AS date,
    """ + cents("l_extendedprice") + """ AS cents, inv.id AS invoice, inv.cents AS room, l_linenumber
  FROM line JOIN inv ON l_orderkey = inv.pos WHERE CAST(l_shipdate AS DATE) <= DATE '2000-06-30' AND (l_linestatus = 'F' OR l_returnflag = 'R')
), app AS (
  SELECT scenario_id, pos, id AS source_id, invoice AS target_invoice, CAST(least(cents, room - used) AS BIGINT) AS cents
  FROM (SELECT *, coalesce(sum(cents) OVER (PARTITION BY invoice ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM src WHERE l_linenumber <> 7)
  WHERE room > used
), ifact AS (
  SELECT *, cents - applied AS opened, CASE WHEN cents = applied THEN 'paid' WHEN due < DATE '2000-06-30' THEN 'overdue' ELSE 'outstanding' END AS status
  FROM (SELECT inv.*, CAST(coalesce((SELECT sum(a.cents) FROM app a WHERE a.target_invoice = inv.id), 0) AS BIGINT) AS applied FROM inv)
), sfact AS (
  SELECT *, cents - applied AS opened FROM (SELECT src.*, CAST(coalesce((SELECT sum(a.cents) FROM app a WHERE a.source_id = src.id), 0) AS BIGINT) AS applied FROM src)
), tot AS (
  SELECT c.scenario_id, CAST(coalesce(i.x, 0) AS BIGINT) AS open_total, CAST(coalesce(s.p, 0) AS BIGINT) AS cash, CAST(coalesce(s.c, 0) AS BIGINT) AS credit, CAST(coalesce(i.x, 0) - coalesce(s.p, 0) - coalesce(s.c, 0) AS BIGINT) AS net
  FROM client c LEFT JOIN (SELECT scenario_id, sum(opened) AS x FROM ifact GROUP BY ALL) i USING (scenario_id)
  LEFT JOIN (SELECT scenario_id, sum(opened) FILTER (kind = 'payment') AS p, sum(opened) FILTER (kind = 'credit_memo') AS c FROM sfact GROUP BY ALL) s USING (scenario_id)
), amb AS (
  SELECT s.scenario_id, s.kind, s.pos, s.id AS source_id, string_agg(i.id, ',' ORDER BY i.pos) AS candidates
  FROM sfact s JOIN ifact i ON i.scenario_id = s.scenario_id AND i.opened = s.cents WHERE s.opened > 0 GROUP BY ALL HAVING count(*) > 1
), doc AS (
  SELECT scenario_id, 0 AS rank, 'invoice' AS kind, pos, id, date, due, cents FROM inv
  UNION ALL SELECT scenario_id, CASE kind WHEN 'payment' THEN 1 ELSE 2 END, kind, pos, id, date, NULL, cents FROM src
), sig AS (
  SELECT scenario_id,
    EXISTS (SELECT 1 FROM sfact s WHERE s.scenario_id = c.scenario_id AND s.kind = 'payment' AND s.opened > 0) AS unapplied_cash,
    EXISTS (SELECT 1 FROM ifact i WHERE i.scenario_id = c.scenario_id AND i.applied > 0 AND i.applied < i.cents) AS "partial",
    EXISTS (SELECT 1 FROM sfact s WHERE s.scenario_id = c.scenario_id AND s.kind = 'credit_memo' AND s.opened > 0) AS open_credit,
    EXISTS (SELECT 1 FROM inv i JOIN inv j ON i.scenario_id = j.scenario_id AND i.cents = j.cents AND i.id <> j.id WHERE i.scenario_id = c.scenario_id) AS near_duplicate,
    EXISTS (SELECT 1 FROM doc d WHERE d.scenario_id = c.scenario_id AND d.date >= DATE '2000-06-25') AS cutoff_risk,
    EXISTS (SELECT 1 FROM amb a WHERE a.scenario_id = c.scenario_id) AS ambiguous
  FROM client c
), owed AS (
  SELECT c.scenario_id, (SELECT count(*) FROM ifact i WHERE i.scenario_id = c.scenario_id AND i.opened > 0) AS ni,
    (SELECT count(*) FROM sfact s WHERE s.scenario_id = c.scenario_id AND s.opened > 0 AND s.kind = 'payment') AS np,
    (SELECT count(*) FROM sfact s WHERE s.scenario_id = c.scenario_id AND s.opened > 0 AND s.kind = 'credit_memo') AS nc FROM client c
), golden AS (
  SELECT c.scenario_id, 'Dear ' || name || ' team,' || chr(10) || chr(10) || 'Thank you for reaching out about your account. Here is the current position as of 2000-06-30.' || chr(10) || chr(10)
    || 'The balance due on your account is ' || """ + money("net") + """ || '.' || chr(10) || chr(10)
    || coalesce((SELECT 'This balance reflects the following open invoices:' || chr(10) || string_agg('- ' || id || ' dated ' || date || ', due ' || due || ': ' || """ + money("opened") + """ || ' ' || status || '.' || chr(10), '' ORDER BY pos) || chr(10) FROM ifact i WHERE i.scenario_id = c.scenario_id AND opened > 0), '')
    || coalesce((SELECT string_agg('We have received your payment ' || id || ' of ' || """ + money("opened") + """ || ', which has not yet been applied to a specific invoice. It is reflected in the balance above.' || chr(10), '' ORDER BY pos) FROM sfact s WHERE s.scenario_id = c.scenario_id AND opened > 0 AND kind = 'payment'), '')
    || coalesce((SELECT string_agg('An open credit memo ' || id || ' of ' || """ + money("opened") + """ || ' is also reflected in the balance above.' || chr(10), '' ORDER BY pos) FROM sfact s WHERE s.scenario_id = c.scenario_id AND opened > 0 AND kind = 'credit_memo'), '')
    || CASE WHEN EXISTS (SELECT 1 FROM sfact s WHERE s.scenario_id = c.scenario_id AND opened > 0) THEN chr(10) ELSE '' END
    || 'If you have questions about any of the items above, please reply to this message and we will be glad to walk through them with you.' || chr(10) || chr(10) || 'Kind regards,' || chr(10) || 'Accounts Receivable' AS draft, net
  FROM client c JOIN tot t USING (scenario_id)
)
"""

_LABELS = ("unapplied_cash", "partial", "open_credit", "near_duplicate", "cutoff_risk", "ambiguous")
_BITS = "||".join(f"CAST(CAST(\"{x}\" AS INTEGER) AS VARCHAR)" for x in _LABELS)
_SHARED = " + ".join(f"CAST(q.\"{x}\" AND m.\"{x}\" AS INTEGER)" for x in _LABELS)
_SHOW = lambda *cs: ", ".join(f"{money(c)} AS {n}" for n, c in cs)

LEDGER = {
    "applied_to_invoice": "SELECT scenario_id, id, applied AS applied_cents FROM ifact",
    "open_amount": "SELECT scenario_id, id, opened AS open_cents FROM ifact",
    "applied_from_source": "SELECT scenario_id, id, applied AS applied_cents FROM sfact",
    "unapplied_amount": "SELECT scenario_id, kind, id, opened AS unapplied_cents FROM sfact",
    "invoice_status": "SELECT scenario_id, id, status FROM ifact",
    "open_invoice_total": "SELECT scenario_id, open_total AS open_invoice_total FROM tot",
    "unapplied_cash_total": "SELECT scenario_id, cash AS unapplied_cash_total FROM tot",
    "unapplied_credit_total": "SELECT scenario_id, credit AS unapplied_credit_total FROM tot",
    "net_balance": "SELECT scenario_id, net AS net_balance FROM tot",
    "ambiguous_allocations": "SELECT scenario_id, source_id, candidates FROM amb",
    "signature": "SELECT * FROM sig",
    "detected_labels": "SELECT scenario_id, concat_ws(',', " + ", ".join(f"CASE WHEN \"{x}\" THEN '{x}' END" for x in _LABELS) + ") AS labels FROM sig",
    "validate_ledger": """, kept AS (SELECT * FROM inv WHERE pos % 11 <> 0), twice AS (SELECT scenario_id, source_id, target_invoice, CASE WHEN pos % 5 = 0 THEN 2 * cents ELSE cents END AS cents FROM app)
        SELECT scenario_id, 'application to unknown invoice' AS problem, target_invoice AS id FROM twice WHERE target_invoice NOT IN (SELECT id FROM kept)
        UNION ALL SELECT kept.scenario_id, 'over-applied invoice', id FROM kept WHERE (SELECT sum(cents) FROM twice WHERE target_invoice = kept.id) > kept.cents
        UNION ALL SELECT src.scenario_id, 'over-applied ' || CASE kind WHEN 'payment' THEN 'payment' ELSE 'credit memo' END, id FROM src WHERE (SELECT sum(cents) FROM twice WHERE source_id = src.id) > src.cents""",
    "net_balance_naive": "SELECT c.scenario_id, CAST(coalesce((SELECT sum(cents) FROM inv i WHERE i.scenario_id = c.scenario_id), 0) - coalesce((SELECT sum(cents) FROM src s WHERE s.scenario_id = c.scenario_id), 0) AS BIGINT) AS net_balance FROM client c",
    "document_ids": "SELECT DISTINCT scenario_id, id FROM doc",
    "find_document": "SELECT scenario_id, id, kind, CAST(date AS VARCHAR) AS date, cents AS amount_cents FROM doc UNION ALL SELECT scenario_id, 'INV-0000', '', NULL, NULL FROM client",
    "account_summary": "SELECT scenario_id, client_id, name, CAST(as_of AS VARCHAR) AS as_of, net AS net_balance, " + _SHOW(("net_balance_text", "net"), ("open_invoice_total_text", "open_total"), ("unapplied_cash_total_text", "cash"), ("unapplied_credit_total_text", "credit")) + f", {_BITS} AS bits FROM client JOIN tot USING (scenario_id) JOIN sig USING (scenario_id)",
    "list_open_invoices": "SELECT scenario_id, id, CAST(due AS VARCHAR) AS due, status, memo, " + _SHOW(("original_text", "cents"), ("applied_text", "applied"), ("open_text", "opened")) + " FROM ifact WHERE opened > 0",
    "get_invoice": "SELECT scenario_id, 'invoice no. 00' || pos AS argument, id, opened AS open_cents, (SELECT string_agg(source_id || '=' || a.cents, ',' ORDER BY a.pos) FROM app a WHERE a.target_invoice = ifact.id) AS applications, CAST(NULL AS VARCHAR) AS error FROM ifact UNION ALL SELECT scenario_id, ' nothing ', 'nothing', NULL, NULL, 'unknown invoice id: nothing' FROM client",
    "list_unapplied_sources": "SELECT scenario_id, kind AS type, id, " + _SHOW(("original_text", "cents"), ("unapplied_text", "opened")) + " FROM sfact WHERE opened > 0",
    "get_source": "SELECT scenario_id, lower(replace(id, '-', '_')) AS argument, id, opened AS unapplied_cents, (SELECT string_agg(target_invoice || '=' || a.cents, ',' ORDER BY a.pos) FROM app a WHERE a.source_id = sfact.id) AS applications, CAST(NULL AS VARCHAR) AS error FROM sfact UNION ALL SELECT scenario_id, lower(replace(id, '-', '_')), id, NULL, NULL, id || ' is an invoice; use get_invoice' FROM inv",
    "tool_requests": """, fixed AS (SELECT * FROM (VALUES ('no_tool', 'unknown tool: get_nothing'), ('more', 'list_open_invoices takes []'), ('less', 'get_invoice takes [invoice_id]'), ('number', 'source_id must be a string'), ('broken', 'arguments must be a JSON object'), ('nothing', 'unknown invoice id: nothing')) AS v(c, e))
        SELECT scenario_id || ' ' || c AS request_id, false AS ok, e AS error, CAST(NULL AS VARCHAR) AS told FROM client, fixed
        UNION ALL SELECT replace(scenario_id, 'S-', 'T-') || ' stranger', false, 'unknown scenario: ' || replace(scenario_id, 'S-', 'T-'), NULL FROM client
        UNION ALL SELECT scenario_id || ' account', true, NULL, CAST(net AS VARCHAR) FROM tot
        UNION ALL SELECT scenario_id || ' open', true, NULL, coalesce((SELECT string_agg(id, ',' ORDER BY pos) FROM ifact i WHERE i.scenario_id = c.scenario_id AND opened > 0), '') FROM client c
        UNION ALL SELECT scenario_id || ' unapplied', true, NULL, coalesce((SELECT string_agg(id, ',' ORDER BY kind DESC, pos) FROM sfact s WHERE s.scenario_id = c.scenario_id AND opened > 0), '') FROM client c
        UNION ALL SELECT scenario_id || ' history', true, NULL, (SELECT count(*) || ':' || CAST(coalesce(2 * sum(cents), 0) AS BIGINT) FROM app a WHERE a.scenario_id = c.scenario_id) FROM client c
        UNION ALL SELECT scenario_id || ' get_invoice ' || id, true, NULL, CAST(opened AS VARCHAR) FROM ifact
        UNION ALL SELECT scenario_id || ' get_invoice ' || id, false, 'unknown invoice id: ' || id, NULL FROM sfact
        UNION ALL SELECT scenario_id || ' get_source ' || id, true, NULL, CAST(opened AS VARCHAR) FROM sfact
        UNION ALL SELECT scenario_id || ' get_source ' || id, false, id || ' is an invoice; use get_invoice', NULL FROM inv""",
    "model_calls": """, tries AS (SELECT 'Rate the reply to ' || scenario_id AS prompt, t AS attempt, answers[1 + (c_custkey * 5 + t * t) % 11] AS output, problems[1 + (c_custkey * 5 + t * t) % 11] AS error
          FROM client, range(1, 4) AS r(t), (SELECT ['{"tone": 3, "verdict": "good"}', '{"tone": 1, "verdict": "bad", "notes": ["x", "y"]}', '{"tone": 7, "verdict": "good"}', '{"tone": "3", "verdict": "good"}', '{"tone": 3}', '{"tone": 3, "verdict": "so"}', '{"tone": 3, "verdict": "bad", "why": 1}', '{"tone": 3, "verdict": "bad", "notes": ["a", ""]}', '{"tone": ', '[]', NULL] AS answers,
            [NULL, NULL, '$.tone: maximum is 4', '$.tone: not of type integer', '$: lacks verdict', '$.verdict: not one of good, bad', '$: has other keys', '$.notes[]: shorter than 1', 'not JSON', '$: not of type object', 'no answer'] AS problems))
        SELECT prompt, CAST(attempt AS INTEGER) AS attempt, error IS NULL AS ok, error, output, bool_or(error IS NULL) OVER (PARTITION BY prompt) AS answered
        FROM tries a WHERE NOT EXISTS (SELECT 1 FROM tries b WHERE b.prompt = a.prompt AND b.attempt < a.attempt AND b.error IS NULL)""",
    "application_history": "SELECT a.scenario_id, source_id, s.kind AS source_type, target_invoice, " + money("a.cents") + " AS amount_text FROM app a JOIN src s ON s.id = a.source_id",
    "applied_totals": "SELECT scenario_id, 'invoice' AS kind, id, applied AS applied_cents FROM ifact UNION ALL SELECT scenario_id, kind, id, applied FROM sfact",
    "golden_draft": "SELECT scenario_id, draft FROM golden",
    "ledger_block": "SELECT c.scenario_id, 'CLIENT: ' || name || ' (' || client_id || ') | terms: net ' || terms_days || ' | as_of ' || as_of || chr(10) || 'INVOICES:' || chr(10)"
    " || coalesce((SELECT string_agg('  ' || id || ' | date ' || date || ' | due ' || due || ' | amount ' || " + money("cents") + " || ' | applied ' || " + money("applied") + " || ' | open ' || " + money("opened") + " || ' | ' || status || chr(10), '' ORDER BY pos) FROM ifact i WHERE i.scenario_id = c.scenario_id), '  (none)' || chr(10))"
    + "".join(f" || '{title}:' || chr(10) || coalesce((SELECT string_agg('  ' || id || ' | date ' || date || ' | amount ' || " + money("cents") + " || ' | applied ' || " + money("applied") + " || ' | unapplied ' || " + money("opened") + f" || chr(10), '' ORDER BY pos) FROM sfact s WHERE s.scenario_id = c.scenario_id AND kind = '{kind}'), '  (none)' || chr(10))" for title, kind in (("PAYMENTS", "payment"), ("CREDIT MEMOS", "credit_memo")))
    + " || 'APPLICATIONS:' || chr(10) || coalesce((SELECT string_agg('  ' || source_id || ' -> ' || target_invoice || ': ' || " + money("cents") + " || chr(10), '' ORDER BY pos) FROM app a WHERE a.scenario_id = c.scenario_id), '  (none)' || chr(10))"
    " || 'TOTALS:' || chr(10) || '  open invoice total: ' || " + money("open_total") + " || chr(10) || '  unapplied cash total: ' || " + money("cash") + " || chr(10) || '  unapplied credit total: ' || " + money("credit") + " || chr(10) || '  NET BALANCE DUE: ' || " + money("net") + " AS block FROM client c JOIN tot USING (scenario_id)",
    "records_block": "SELECT c.scenario_id, 'CLIENT ' || client_id || ' (' || name || ') | as_of ' || as_of || chr(10)"
    " || coalesce((SELECT string_agg('INVOICE ' || id || ' | date ' || date || ' | due ' || due || ' | amount ' || " + money("cents") + " || ' | open ' || " + money("opened") + " || ' | status ' || status || CASE memo WHEN '' THEN '' ELSE ' | memo: ' || memo END || chr(10), '' ORDER BY pos) FROM ifact i WHERE i.scenario_id = c.scenario_id), '')"
    + "".join(f" || coalesce((SELECT string_agg('{title} ' || id || ' | date ' || date || ' | amount ' || " + money("cents") + " || ' | unapplied ' || " + money("opened") + f" || '{note}' || chr(10), '' ORDER BY pos) FROM sfact s WHERE s.scenario_id = c.scenario_id AND kind = '{kind}'), '')" for title, kind, note in (("PAYMENT", "payment", " | method ach"), ("CREDIT MEMO", "credit_memo", "")))
    + " || coalesce((SELECT string_agg('APPLIED ' || source_id || ' -> ' || target_invoice || ': ' || " + money("cents") + " || chr(10), '' ORDER BY pos) FROM app a WHERE a.scenario_id = c.scenario_id), '') || 'NET BALANCE DUE ' || " + money("net") + " AS block FROM client c JOIN tot USING (scenario_id)",
    "prompt_assembly": "SELECT c.scenario_id, 'To ' || name || chr(10) || chr(10) || 'Records:' || chr(10) || " + money("net") + " AS prompt FROM client c JOIN tot USING (scenario_id)",
    "money_render": "SELECT scenario_id, " + money("net") + " AS shown, " + money("-net - 7") + " AS negative FROM tot",
    "money_parse": "SELECT scenario_id, net AS parsed, CAST(NULL AS BIGINT) AS odd, CAST(125050 AS BIGINT) AS tenths FROM tot",
    "whole_percent": "SELECT scenario_id, id, CAST(round_even(100.0 * applied / cents, 0) AS BIGINT) AS share FROM ifact",
    "report_shares": "SELECT scenario_id, " + percent("ni", "ni + np + nc") + " AS share, ni || '/' || (ni + np + nc) || ' (' || " + percent("ni", "ni + np + nc") + " || ')' AS ratio, CASE WHEN np > nc THEN '+' ELSE '' END || (np - nc) AS delta FROM owed",
    "amount_tokens": "SELECT scenario_id, id, opened AS dollars, opened AS plain, opened AS usd, opened AS suffixed, opened // 100 * 100 AS whole, [CAST(700 AS BIGINT), 2100, 40000, 309900][1 + opened % 4] AS words, CAST(NULL AS BIGINT) AS share FROM ifact",
    "date_tokens": "SELECT scenario_id, id, CAST(date AS VARCHAR) AS iso, CAST(date AS VARCHAR) AS named, CAST(date AS VARCHAR) AS slashed, CAST(NULL AS VARCHAR) AS impossible FROM inv",
    "canonical_ids": "SELECT scenario_id, id, id AS explicit, id AS loose, id AS padded, 'INV-999999999' AS unknown FROM inv",
    "class_keys": f"SELECT scenario_id, {_BITS} AS class_key FROM sig",
    "golden_claims": "SELECT scenario_id, ni + np + nc AS n_exist, ni + np + nc AS n_amount, CAST(1 AS BIGINT) AS n_sum, 1 + 2 * ni AS n_date, ni AS n_status_of_invoices FROM owed",
    "golden_checks": "SELECT scenario_id, CAST(0 AS BIGINT) AS failed, 2 * (ni + np + nc) + 2 + 3 * ni AS passed FROM owed",
    "golden_decisions": "SELECT scenario_id, CASE WHEN ambiguous THEN 'abstain' ELSE 'human_gate' END AS action, CASE WHEN ambiguous THEN 'ambiguous allocation' ELSE 'all checks passed' END AS reason FROM sig",
    "golden_scores": "SELECT scenario_id, 2 * (ni + np + nc) + 2 + 3 * ni AS grounding_checked, 2 * (ni + np + nc) + 2 + 3 * ni AS grounding_total, 1 + CAST(ni > 0 AS BIGINT) + CAST(np > 0 AS BIGINT) + CAST(nc > 0 AS BIGINT) AS completeness_present, 1 + CAST(ni > 0 AS BIGINT) + CAST(np > 0 AS BIGINT) + CAST(nc > 0 AS BIGINT) AS completeness_total FROM owed",
    "oracle_grounding": "SELECT scenario_id, 1 + 2 * (ni + np + nc) AS verified, 1 + 2 * (ni + np + nc) AS total FROM owed",
    "truth_sets": ", every AS (SELECT scenario_id, cents AS x FROM doc UNION SELECT scenario_id, opened FROM ifact UNION SELECT scenario_id, opened FROM sfact UNION SELECT scenario_id, unnest([open_total, cash, credit, net]) FROM tot)"
    " SELECT e.scenario_id, count(*) AS figures, CAST(sum(x) AS BIGINT) AS figure_sum FROM every e JOIN tot t USING (scenario_id) WHERE x <> 0 OR net = 0 GROUP BY ALL",
    "break_sum": "SELECT scenario_id, regexp_replace(draft, '(balance due on your account is )[^ ]*[.]' || chr(10), '\\1' || " + money("net + 1000") + " || '.' || chr(10)) AS draft FROM golden",
    "inject_fuzzy": "SELECT scenario_id, draft || chr(10) || chr(10) || CASE length(draft) % 2 WHEN 0 THEN 'Your account manager approved a waiver of the late fees on this balance.' ELSE 'As we discussed by phone, we will hold this invoice until next quarter.' END AS draft FROM golden",
    "error_decisions": """, e AS (
        SELECT scenario_id, v.*, ambiguous, ni > 0 AS listed, cash > 0 AS loose, credit > 0 AS credited, EXISTS (SELECT 1 FROM ifact i WHERE i.scenario_id = sig.scenario_id AND opened > 0 AND applied > 0) AS partly
        FROM sig JOIN owed USING (scenario_id) JOIN tot USING (scenario_id), (VALUES ('clean', 0, 'human_gate'), ('fabricate_id', 1, 'escalate'), ('break_sum', 1, 'revise'), ('T2-SUM-IGNORES-UNAPPLIED', 2, 'revise'),
          ('T2-FULL-ORIGINAL-AMOUNTS', 2, 'revise'), ('T2-CREDITS-ASSUMED-APPLIED', 2, 'revise'), ('ambiguous', 3, 'abstain'), ('inject_fuzzy', 4, 'escalate')) AS v(error, tier, action))
        SELECT scenario_id, error, tier, CASE WHEN error = 'T2-CREDITS-ASSUMED-APPLIED' AND ambiguous THEN 'abstain' ELSE action END AS action, error <> 'clean' AS caught FROM e
        WHERE CASE error WHEN 'clean' THEN NOT ambiguous WHEN 'ambiguous' THEN ambiguous WHEN 'fabricate_id' THEN listed WHEN 'T2-SUM-IGNORES-UNAPPLIED' THEN loose WHEN 'T2-FULL-ORIGINAL-AMOUNTS' THEN partly WHEN 'T2-CREDITS-ASSUMED-APPLIED' THEN credited ELSE true END""",
    "gaps": "SELECT 'allocation_reference' AS missing, count(*) AS gap_count FROM sig WHERE ambiguous HAVING count(*) > 0",
    "precheck_abstain": "SELECT scenario_id, 'abstain' AS action, 'ambiguous allocation' AS reason FROM sig WHERE ambiguous",
    "memory_kept": f", m AS (SELECT 'mem-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS entry_id, c_custkey AS o, {_BITS} AS class_key FROM sig JOIN client USING (scenario_id) WHERE pool = 'A') SELECT entry_id, class_key FROM (SELECT *, row_number() OVER (PARTITION BY class_key ORDER BY o DESC, entry_id DESC) AS n FROM m) WHERE n <= 3",
    "memory_retrieve": f", m AS (SELECT * FROM (SELECT sig.*, 'mem-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS entry_id, c_custkey AS o, 1.0 + c_custkey % 4 // 2 AS w, {_BITS} AS class_key, row_number() OVER (PARTITION BY {_BITS} ORDER BY c_custkey DESC) AS n FROM sig JOIN client USING (scenario_id) WHERE pool = 'A') WHERE n <= 3), q AS (SELECT sig.*, {_BITS} AS class_key FROM sig JOIN client USING (scenario_id) WHERE pool = 'B')"
    f" SELECT query_id, CAST(place AS INTEGER) AS place, entry_id FROM (SELECT q.scenario_id AS query_id, entry_id, row_number() OVER (PARTITION BY q.scenario_id ORDER BY q.class_key = m.class_key DESC, {_SHARED} DESC, w DESC, o DESC, entry_id) AS place FROM q, m WHERE q.class_key = m.class_key OR {_SHARED} > 0) WHERE place <= 3",
    "required_evidence": "SELECT scenario_id, 'get_account_summary' AS tool_name, '' AS argument FROM client UNION ALL SELECT scenario_id, 'list_open_invoices', '' FROM client UNION ALL SELECT scenario_id, 'list_unapplied_sources', '' FROM tot WHERE cash <> 0 OR credit <> 0 UNION ALL SELECT scenario_id, 'get_invoice', id FROM ifact WHERE status = 'overdue'",
    "behaviours": "SELECT 'pass1' AS pass_label, b AS behaviour, CAST(p AS BIGINT) AS present, CAST(a AS BIGINT) AS applicable FROM (SELECT count(*) AS n, count_if(ni > 0) AS i, count_if(np + nc > 0) AS u FROM owed), LATERAL (VALUES ('greets the client by name', n, n), ('itemizes open invoices with issue and due dates', i, i), ('explains unapplied cash or credit in place', u, u), ('invites reconciliation in the closing', 0, n)) AS v(b, p, a)",
}
# Sentences that are wrong in known ways: what each must come to, by case.
_CASES = "(VALUES " + ", ".join(f"('{c}', {2 if two else 1}, '{kind}', '{role}', '{status}')" for c, (_, two, kind, role, status) in CASES.items()) + ") AS v(\"case\", needs, type, role, status)"
_FIRST = """, o AS (
  SELECT scenario_id, max(opened) FILTER (n = 1) AS i, max(cents) FILTER (n = 1) AS face, max(applied) FILTER (n = 1) AS used, max(opened) FILTER (n = 2) AS j
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY pos) AS n FROM ifact WHERE opened > 0) GROUP BY 1
) """
_CENTS = {
    "open_right": "i", "open_wrong": "i + 100", "open_usd": "i", "open_dollars": "i", "open_commas": "i // 100 * 100 + 100000000", "open_plain": "i", "open_grouped": "i", "open_words": "309900", "original_right": "face", "original_wrong": "face + 1",
    "applied_right": "used", "applied_wrong": "used + 1", "unbound": "77", "received_wrong": "77", "remit_right": "net", "remit_wrong": "net + 1", "total_wrong": "net + 1", "subtotal_right": "i + j", "subtotal_wrong": "i + j + 1",
    "two_documents": "j", "amount_first": "i",
}
_RIGHT = "CASE WHEN ambiguous THEN '{}' ELSE '{}' END"
_PASSED = (_RIGHT.format("abstain", "human_gate"), _RIGHT.format("ambiguous allocation", "all checks passed"))
#: The first figure that isn't the net balance, else the first; its first two neighbouring digits that differ, not the leading one if others do, change places.
_SWAP = r""", figure AS (
  SELECT scenario_id, draft, gaps, f, coalesce(list_filter(range(1, len(f) + 1), lambda i: f[i] <> """ + money("net") + r""")[1], 1) AS i FROM (
    SELECT scenario_id, draft, tot.net, string_split_regex(draft, '-?\$[0-9,]+(?:\.[0-9]{1,2})?') AS gaps, regexp_extract_all(draft, '-?\$[0-9,]+(?:\.[0-9]{1,2})?') AS f FROM golden JOIN tot USING (scenario_id))
), digits AS (
  SELECT scenario_id, draft, f[i] AS token, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
    CAST(CAST(regexp_replace(f[i], '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR) AS v FROM figure
), pairs AS (
  SELECT *, list_filter(range(1, length(v)), lambda k: substr(v, k, 1) <> substr(v, k + 1, 1)) AS c FROM digits
), swapped AS (
  SELECT scenario_id, draft, token, start, CASE WHEN token LIKE '-%' OR len(c) = 0 THEN NULL ELSE CAST(substr(v, 1, k - 1) || substr(v, k + 1, 1) || substr(v, k, 1) || substr(v, k + 2) AS BIGINT) END AS w
  FROM (SELECT *, coalesce(list_filter(c, lambda k: k > 1)[1], c[1]) AS k FROM pairs)
) """
LEDGER |= {
    "spoiled_claims": _FIRST + 'SELECT scenario_id, "case", type, role, CAST(CASE "case" ' + " ".join(f"WHEN '{c}' THEN {x}" for c, x in _CENTS.items()) + f" END AS BIGINT) AS cents, status FROM o JOIN tot USING (scenario_id) JOIN owed USING (scenario_id), {_CASES} WHERE needs <= ni",
    "spoiled_decisions": f"""SELECT scenario_id, "case", CAST(r AS INTEGER) AS revision_index,
        CASE WHEN status = 'fail' AND r = 0 THEN 'revise' ELSE 'escalate' END AS action,
        CASE WHEN status <> 'fail' THEN 'unverifiable quantitative claim' WHEN r = 0 THEN 'correctable code-check failure' ELSE 'revision budget exhausted' END AS reason
        FROM owed, {_CASES}, (VALUES (0), (2)) AS w(r) WHERE needs <= ni AND status <> 'pass'""",
    "fuzzy_decisions": f"""SELECT scenario_id, "case", CAST(r AS INTEGER) AS revision_index,
        CASE "case" WHEN 'supported' THEN {_PASSED[0]} WHEN 'unsupported' THEN CASE r WHEN 0 THEN 'revise' ELSE 'escalate' END ELSE 'escalate' END AS action,
        CASE "case" WHEN 'supported' THEN {_PASSED[1]} WHEN 'unsupported' THEN CASE r WHEN 0 THEN 'unsupported fuzzy claim' ELSE 'unsupported fuzzy claim after revision' END ELSE 'fuzzy claim cannot be determined from the records' END AS reason
        FROM sig, (VALUES ('supported'), ('uncited'), ('miscited'), ('unsupported'), ('unsure'), ('failed')) AS v("case"), (VALUES (0), (1)) AS w(r)""",
    "content_decisions": f""", c AS (
        SELECT scenario_id, "case", ambiguous, ni >= 2 AND np + nc = 0 AND "case" = 'originals' AND EXISTS (SELECT 1 FROM ifact i WHERE i.scenario_id = owed.scenario_id AND opened > 0 AND applied > 0) AS contradicts,
          "case" = 'bare' AND ni > 0 OR np + nc > 0 AS incomplete FROM owed JOIN sig USING (scenario_id), (VALUES ('bare'), ('originals')) AS v("case"))
        SELECT scenario_id, "case", CASE WHEN ambiguous THEN 'abstain' WHEN contradicts OR incomplete THEN 'revise' ELSE 'human_gate' END AS action,
          CASE WHEN ambiguous THEN 'ambiguous allocation' WHEN contradicts THEN 'itemized amounts contradict the computed totals' WHEN incomplete THEN 'draft is missing required content' ELSE 'all checks passed' END AS reason FROM c""",
    "run_rounds": "SELECT scenario_id, 0 AS revision_index, CASE WHEN ambiguous THEN 'abstain' ELSE 'revise' END AS action, CASE WHEN ambiguous THEN 'ambiguous allocation' ELSE 'correctable code-check failure' END AS reason, ambiguous AS terminal FROM sig UNION ALL SELECT scenario_id, 1, 'human_gate', 'all checks passed', true FROM sig WHERE NOT ambiguous",
    "validate_other_rules": """, i AS (SELECT scenario_id, id, date, CASE WHEN pos % 7 = 0 THEN date - 1 ELSE due END AS due FROM inv UNION ALL SELECT scenario_id, id, date, CASE WHEN pos % 7 = 0 THEN date - 1 ELSE due END FROM inv WHERE pos % 13 = 0),
        c AS (SELECT scenario_id, CASE WHEN c_custkey % 2 = 0 THEN DATE '1996-01-01' ELSE as_of END AS as_of FROM client)
        SELECT scenario_id, 'duplicate id' AS problem, id FROM i GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT scenario_id, 'application from unknown source', 'PMT-0' FROM app WHERE pos % 3 = 0
        UNION ALL SELECT scenario_id, 'due before date', id FROM i WHERE due < date
        UNION ALL SELECT scenario_id, 'invoice after as_of', id FROM i JOIN c USING (scenario_id) WHERE date > c.as_of
        UNION ALL SELECT scenario_id, CASE kind WHEN 'payment' THEN 'payment' ELSE 'credit memo' END || ' after as_of', id FROM src JOIN c USING (scenario_id) WHERE date > c.as_of""",
    "memory_ingest": f""", m AS (SELECT 'mem-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS entry_id, event_id AS o, {_BITS} AS class_key, CASE event_type WHEN 'view' THEN 1.0 ELSE 2.0 END AS weight
          FROM events JOIN sig ON sig.scenario_id = 'S-' || user_id JOIN client ON client.scenario_id = sig.scenario_id WHERE pool = 'A' AND event_id % 5 <> 0 AND event_type <> 'click')
        SELECT entry_id, class_key, CAST(weight AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY class_key ORDER BY o DESC, entry_id DESC) AS n FROM m) WHERE n <= 3""",
    "corrections": """SELECT scenario_id, 'break_sum' AS "case", 'The ledger shows ' || """ + money("net") + """ || ' for the total balance due; your draft says ' || """ + money("net + 1000") + """ || '.' AS payload, 'c_sum_fail' AS kinds,
          'The ledger shows ' || """ + money("net") + """ || ' for the total balance due; your draft says ' || """ + money("net + 1000") + """ || '.' AS corrections FROM tot
        UNION ALL SELECT scenario_id, 'fabricate_id', NULL, 'c_exist_fail', '' FROM owed WHERE ni > 0""",
    "swap_amount": _SWAP + "SELECT scenario_id, CASE WHEN w <> 0 THEN substr(draft, 1, start) || " + money("w") + " || substr(draft, start + length(token) + 1) END AS draft FROM swapped",
    "fabricate_id": """, g AS (SELECT scenario_id, draft, (SELECT list(id) FROM inv i WHERE i.scenario_id = golden.scenario_id) AS ids FROM golden), f AS (
        SELECT scenario_id, draft, list_sort(list_transform(list_filter(ids, lambda x: strpos(draft, x) > 0), lambda x: {'at': strpos(draft, x), 'id': x}))[1] AS r,
          list_filter(list_transform(range(1000), lambda n: 'INV-9' || lpad(CAST(n AS VARCHAR), 3, '0')), lambda x: NOT list_contains(ids, x) AND strpos(draft, x) = 0)[1] AS k FROM g)
        SELECT scenario_id, CASE WHEN r IS NOT NULL THEN substr(draft, 1, r.at - 1) || k || substr(draft, r.at + length(r.id)) END AS draft FROM f""",
}
LEDGER |= {
    "injected_errors": _SWAP + LEDGER["error_decisions"].split("SELECT scenario_id, error, tier,")[0] + ", rows AS (SELECT scenario_id, error, tier," + LEDGER["error_decisions"].split("SELECT scenario_id, error, tier,")[1]
    + """), every AS (SELECT tier, caught FROM rows UNION ALL SELECT 1, true FROM swapped WHERE w <> 0), clean AS (SELECT count(*) AS clean, count_if(NOT caught) AS quiet FROM every WHERE tier = 0)
        SELECT *, (sensitivity + specificity) // 2 AS balanced FROM (SELECT tier, count(*) AS errors, count_if(caught) AS caught, any_value(clean) AS clean, any_value(quiet) AS quiet, 100 * count_if(caught) // count(*) AS sensitivity, 100 * any_value(quiet) // any_value(clean) AS specificity FROM every, clean WHERE tier > 0 GROUP BY tier)""",
    "gap_categories": f""", d AS (SELECT 'abstain' AS action, 'ambiguous allocation' AS reason FROM sig WHERE ambiguous UNION ALL SELECT 'escalate', 'fabricated document reference' FROM owed WHERE ni > 0 UNION ALL SELECT 'escalate', 'fuzzy claim cannot be determined from the records' FROM owed
          UNION ALL SELECT 'escalate', CASE "case" WHEN 'unbound' THEN 'unverifiable quantitative claim' ELSE 'revision budget exhausted' END FROM owed, {_CASES} WHERE needs <= ni AND "case" IN ('unbound', 'open_wrong'))
        SELECT missing, would_need, resolvable_by, reason AS detail, count(*) AS n FROM d JOIN (VALUES ('allocation_reference', 'remittance advice tying the payment to an invoice', 'human'), ('unverifiable_quant', 'a claim normalizer for non-canonical amount phrasing', 'tool'),
          ('ambiguous_reference', 'a record or human confirmation of the claimed arrangement', 'human'), ('document_absent', 'drafter constrained to the document set', 'tool'), ('other', 'human review of a draft the loop could not converge', 'human')) AS g(missing, would_need, resolvable_by)
          ON missing = CASE WHEN action = 'abstain' THEN 'allocation_reference' WHEN reason = 'unverifiable quantitative claim' THEN 'unverifiable_quant' WHEN reason = 'fuzzy claim cannot be determined from the records' THEN 'ambiguous_reference' WHEN reason = 'fabricated document reference' THEN 'document_absent' ELSE 'other' END
        WHERE action IN ('abstain', 'escalate') GROUP BY ALL""",
}
LEDGER["draft_prompt"] = ", b AS (" + LEDGER["ledger_block"] + """) SELECT scenario_id, 'You draft replies.' AS system, 'Records:' || chr(10) || block
    || CASE WHEN n % 2 = 0 THEN chr(10) || chr(10) || 'Replies that reviewers approved:' || chr(10) || '--- EXAMPLE 1 START ---' || chr(10) || 'One.' || chr(10) || '--- EXAMPLE 1 END ---' || chr(10) || '--- EXAMPLE 2 START ---' || chr(10) || 'For ' || scenario_id || chr(10) || '--- EXAMPLE 2 END ---' ELSE '' END
    || CASE WHEN n % 3 = 0 THEN chr(10) || chr(10) || 'Your last draft has errors:' || chr(10) || 'The total is wrong.' || chr(10) || 'Mend these only and leave all else as it is.' ELSE '' END AS "user" FROM (SELECT *, CAST(substr(scenario_id, 3) AS BIGINT) AS n FROM b)"""
LEDGER["recovery_loop"] = """, r AS (SELECT scenario_id, CAST(substr(scenario_id, 3) AS BIGINT) % 4 AS w, CAST(2 + (cash <> 0 OR credit <> 0)::INTEGER AS INTEGER) AS n FROM tot)
    SELECT scenario_id, CASE w WHEN 2 THEN '' ELSE 'done' END AS text, CASE w WHEN 0 THEN 2 ELSE 3 END AS llm_calls, CASE w WHEN 0 THEN 3 WHEN 3 THEN 4 ELSE n END AS tool_calls, w <> 0 AS forced_final,
      CASE w WHEN 1 THEN n - 1 WHEN 2 THEN n ELSE 0 END AS forced_calls, CASE w WHEN 3 THEN 2 ELSE 0 END AS cached_calls FROM r"""
LEDGER |= {
    "draft_length": "SELECT pool AS pass_label, CAST(sum(length(draft)) // count(*) AS BIGINT) AS mean_chars FROM golden JOIN client USING (scenario_id) GROUP BY 1",
    "missing_evidence": "SELECT scenario_id, 'get_account_summary' AS tool_name, '' AS argument FROM client WHERE c_custkey % 2 <> 0 UNION ALL SELECT scenario_id, 'list_open_invoices', '' FROM client UNION ALL SELECT scenario_id, 'list_unapplied_sources', '' FROM tot WHERE cash <> 0 OR credit <> 0 UNION ALL SELECT scenario_id, 'get_invoice', id FROM ifact WHERE status = 'overdue' AND pos % 3 <> 0",
    "random_entries": f", m AS (SELECT * FROM (SELECT 'mem-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS entry_id, row_number() OVER (PARTITION BY {_BITS} ORDER BY c_custkey DESC) AS n FROM sig JOIN client USING (scenario_id) WHERE pool = 'A') WHERE n <= 3)"
    " SELECT query_id, CAST(place AS INTEGER) AS place, entry_id FROM (SELECT scenario_id AS query_id, entry_id, row_number() OVER (PARTITION BY scenario_id ORDER BY md5('5|' || scenario_id || '|' || entry_id), entry_id) AS place FROM client, m WHERE pool = 'B') WHERE place <= 2",
}
# A log of scores, generations and decisions read out of the event table.
_LOG = """WITH score AS (
  SELECT event_id AS o, ['pass1', 'pass2', 'pass2R'][1 + event_id % 3] AS pass_label, 'S-' || user_id AS scenario_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS terminal_action FROM events
), last AS (
  SELECT * FROM score s WHERE NOT EXISTS (SELECT 1 FROM score t WHERE t.pass_label = s.pass_label AND t.scenario_id = s.scenario_id AND t.o > s.o)
) """
_K = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) "
_PAIRS = "FROM labels JOIN documents USING (doc_id)"
OTHER = {
    "report_before_after": _LOG + f"SELECT pass_label, count(*) AS scenarios, CAST(sum(k % 10) AS BIGINT) AS grounding_checked, CAST(sum(10 + k // 10) AS BIGINT) AS grounding_total, CAST(sum(k % 10) AS BIGINT) || '/' || CAST(sum(10 + k // 10) AS BIGINT) || ' (' || {percent('CAST(sum(k % 10) AS BIGINT)', 'CAST(sum(10 + k // 10) AS BIGINT)')} || ')' AS grounding FROM last GROUP BY 1",
    "report_action_histogram": _LOG + "SELECT *, CAST(row_number() OVER (PARTITION BY pass_label ORDER BY action_count DESC, terminal_action) AS INTEGER) AS place FROM (SELECT pass_label, terminal_action, count(*) AS action_count FROM last GROUP BY ALL)",
    "report_paired": _LOG + ", p AS (SELECT scenario_id, max(CASE pass_label WHEN 'pass1' THEN 100 * (k % 10) // (10 + k // 10) END) AS a, max(CASE pass_label WHEN 'pass2' THEN 100 * (k % 10) // (10 + k // 10) END) AS b FROM last WHERE pass_label <> 'pass2R' GROUP BY 1) SELECT scenario_id, a IS NOT NULL AND b IS NOT NULL AS paired, CASE WHEN b > a THEN '+' ELSE '' END || (b - a) || 'pp' AS change FROM p",
    "report_traces": f"SELECT event_type AS task, count(*) AS attempts, count_if(value >= 5) AS ok, count_if(value < 5 AND event_id % 2 = 0) AS parse_failures, {percent('count_if(value >= 5)', 'count(*)')} AS ok_share FROM events GROUP BY 1",
    "report_pairwise": f"SELECT count_if(event_type = 'view') AS wins, count_if(event_type NOT IN ('view', 'click')) AS ties, count_if(event_type = 'click') AS losses, count_if(event_type IN ('view', 'click')) AS decisive, count_if(value > 20) AS flips, count(*) AS pairs, {percent('count_if(value > 20)', 'count(*)')} AS flip_rate FROM events",
    "pending_review": "WITH g AS (SELECT event_id // 5 AS gen, max(event_id) FILTER (event_type IN ('view', 'click')) AS v, bool_or(event_type = 'purchase') AS decided FROM events GROUP BY 1) SELECT 'g-' || gen AS gen_id FROM g JOIN events ON event_id = v WHERE event_type = 'view' AND NOT decided",
    "revision_loops": "SELECT run_id, scenario_id, CAST(count_if(again) AS BIGINT) AS loops FROM (SELECT user_id % 7 AS run_id, 'S-' || user_id AS scenario_id, EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_id < e.event_id AND f.props = e.props) AS again FROM events e) GROUP BY ALL",
    "crosscheck": _K + """, g AS (SELECT event_id // 4 AS g, max(k % 3) FILTER (event_id % 4 = 3) AS v, max(k) FILTER (event_id % 4 = 1) AS one, max(k) FILTER (event_id % 4 = 2) AS two, bool_or(event_id % 8 = 0) AS f FROM e GROUP BY 1)
        SELECT 'g-' || g AS gen_id, s % 2 = 1 AND s % 3 = 2 AS gate_clean, v = 2 AS oracle_clean, (s % 2 = 1 AND s % 3 = 2) = (v = 2) AS agree FROM (SELECT *, coalesce(two, one) AS s FROM g) WHERE f AND s IS NOT NULL AND v IS NOT NULL""",
    "recovery_report": _K + f"""SELECT *, CAST(agentic_calls // cases AS VARCHAR) || '.' || (10 * agentic_calls // cases) % 10 AS mean_agentic_calls, CAST(tool_calls // cases AS VARCHAR) || '.' || (10 * tool_calls // cases) % 10 AS mean_tool_calls, {percent('forced_final', 'cases')} AS forced_share
        FROM (SELECT count(*) AS cases, count_if(event_type = 'view') AS prompt_recovered, count_if(value > 5) AS agentic_recovered, count(*) AS prompt_calls, CAST(sum(1 + k % 3) AS BIGINT) AS agentic_calls, CAST(sum(k % 5) AS BIGINT) AS tool_calls, count_if(k % 2 = 0) AS forced_final, count_if(k % 7 = 0) AS coverage_forced FROM e)""",
    "apply_decisions": _K + """, d AS (SELECT 'g-' || event_id AS gen_id, CASE event_type WHEN 'click' THEN 'decline' WHEN 'purchase' THEN 'edit' ELSE 'approve' END AS action, k, user_id % 4 <> 0 AS pending FROM e),
        r AS (SELECT *, CASE WHEN k % 5 <> 0 AND NOT pending THEN 'not pending' WHEN k % 5 <> 0 AND action <> 'decline' AND k % 3 = 0 THEN 'fails a check' END AS refused FROM d)
        SELECT gen_id, action, refused, CASE WHEN refused IS NOT NULL THEN NULL WHEN action = 'decline' THEN '' WHEN action = 'approve' AND k % 2 = 0 THEN CASE WHEN pending THEN 'draft ' || gen_id END WHEN k % 2 = 0 THEN '' ELSE 'T' END AS sent_text FROM r""",
    "over_limits": _K + """, c AS (SELECT event_id % 60 AS gen_id, k % 4 - 1 AS round_index, event_id % 3 = 0 AS cached FROM e)
        SELECT gen_id, 'rounds' AS "limit", count(DISTINCT round_index) AS x FROM c WHERE round_index >= 0 GROUP BY gen_id HAVING count(DISTINCT round_index) > 2
        UNION ALL SELECT gen_id, 'calls_per_round', count(*) FROM c WHERE NOT cached AND round_index >= 0 GROUP BY gen_id, round_index HAVING count(*) > 3
        UNION ALL SELECT gen_id, 'executions', count(*) FROM c WHERE NOT cached GROUP BY gen_id HAVING count(*) > 6""",
    "step_problems": _K + """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_type NOT IN ('view', 'click') THEN 'type must be tools or final' WHEN event_type = 'view' AND k % 5 = 0 THEN 'a tools step needs calls' WHEN event_type = 'view' AND k % 5 = 4 THEN 'too many calls'
        WHEN event_type = 'click' AND k % 3 = 0 THEN 'a final step needs a draft' WHEN event_type = 'click' AND k % 5 > 0 THEN 'a final step takes no calls' END AS problem FROM e""",
    "ingest_counts": "SELECT max(event_id) AS consumed_through_offset, count_if(user_id % 2 = 0 AND event_type <> 'click') AS added, count_if(user_id % 2 = 0 AND event_type = 'click') AS declined FROM events WHERE event_id >= 100",
    "calibration_items": "WITH d AS (SELECT 'd-' || event_id AS draft_id, event_id % 2 = 0 AS clean FROM events), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY clean ORDER BY md5('3|pick|' || draft_id), draft_id) AS BIGINT) AS n FROM d) SELECT 'C-' || lpad(CAST(row_number() OVER (ORDER BY md5('3|blind|' || draft_id), draft_id) AS VARCHAR), 2, '0') AS item_id, draft_id, clean FROM s WHERE n <= 8",
    "rubric_rows": _K + ", r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN k % 6 WHEN 1 THEN 2 END AS tone, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN k % 6 END AS clarity, event_id % 4 = 0 AS acceptable, event_id % 4 < 2 AND k % 6 BETWEEN 1 AND 4 AS ok FROM e) SELECT event_id AS item_id, CASE WHEN ok THEN CAST(tone AS INTEGER) END AS tone, CASE WHEN ok THEN CAST(clarity AS INTEGER) END AS clarity, CASE WHEN ok THEN acceptable END AS acceptable, ok AS parse_ok FROM r",
    "percentile": "SELECT round(quantile_cont(value, 0.3), 6) AS value FROM events",
    "raw_agreement": f"SELECT lang, count(*) AS n, round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS raw_agreement {_PAIRS} GROUP BY 1",
    "cohen_kappa": f"SELECT lang, n, round((po - pe) / (1 - pe), 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM (SELECT lang, count(*) AS n, avg(CAST(quality = toxic AS DOUBLE)) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe {_PAIRS} GROUP BY 1)",
    "weighted_kappa": f"SELECT lang, round(1 - avg((a - b) * (a - b)) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS weighted_kappa FROM (SELECT lang, quality + 2 * (doc_id % 2) AS a, toxic + 2 * (doc_id % 2) AS b {_PAIRS}) GROUP BY 1",
    "kendall_tau_values": """WITH p AS (SELECT event_type, value AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + user_id % 10 AS b, count(*) AS k FROM events GROUP BY ALL),
        t AS (SELECT x.event_type, sum(x.k * y.k * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s, sum(CASE WHEN x.a <> y.a THEN x.k * y.k ELSE 0 END) / 2 AS ua, sum(CASE WHEN x.b <> y.b THEN x.k * y.k ELSE 0 END) / 2 AS ub FROM p x JOIN p y ON x.event_type = y.event_type GROUP BY 1)
        SELECT event_type, CAST(n AS BIGINT) AS n, round(s / sqrt(CAST(ua AS DOUBLE) * ub), 6) AS tau_b FROM t JOIN (SELECT event_type, sum(k) AS n FROM p GROUP BY 1) USING (event_type)""",
    "bootstrap_interval": f"""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS k {_PAIRS} GROUP BY ALL),
        e AS (SELECT a, b, CAST(sum(k) OVER (ORDER BY a, b) AS BIGINT) AS upto, k FROM c), n AS (SELECT CAST(sum(k) AS BIGINT) AS n FROM c),
        d AS (SELECT boot, CAST('0x' || substr(md5(concat_ws('|', 5, boot, i)), 1, 13) AS BIGINT) % n AS place, n FROM range(0, 200) AS r(boot), (SELECT n, unnest(range(0, n)) AS i FROM n)),
        g AS (SELECT boot, a, b, CAST(n AS DOUBLE) AS n FROM d JOIN e ON place < upto AND place >= upto - k),
        m AS (SELECT boot, any_value(n) AS n, avg(CAST(a = b AS INTEGER)) AS po, (sum(a) * sum(b) + (any_value(n) - sum(a)) * (any_value(n) - sum(b))) / (any_value(n) * any_value(n)) AS pe FROM g GROUP BY 1),
        x AS (SELECT (po - pe) / (1 - pe) AS x FROM m WHERE pe < 1)
        SELECT round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM x""",
    "kendall_tau_b": f"WITH p AS (SELECT row_number() OVER () AS i, lang, quality + 2 * (doc_id % 2) AS a, toxic + 2 * (doc_id % 3) AS b {_PAIRS}) SELECT x.lang, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(CAST(count_if(x.a <> y.a) AS DOUBLE) * count_if(x.b <> y.b)), 6) AS tau_b FROM p x JOIN p y ON x.lang = y.lang AND x.i < y.i GROUP BY 1",
    "both_orders": "WITH j AS (SELECT user_id, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS x, max(CASE WHEN event_id % 2 = 1 THEN event_id END) AS y FROM events GROUP BY 1), v AS (SELECT j.user_id, CASE a.event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'error' THEN NULL ELSE 'tie' END AS p, CASE b.event_type WHEN 'view' THEN 'b' WHEN 'click' THEN 'a' WHEN 'error' THEN NULL ELSE 'tie' END AS q FROM j LEFT JOIN events a ON a.event_id = x LEFT JOIN events b ON b.event_id = y) SELECT 'p-' || user_id AS pair_id, CASE WHEN p = q THEN p ELSE 'tie' END AS verdict, coalesce(p <> q, true) AS flipped FROM v",
    "split_sentences": r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '([Nn]o[.])(\s+)', '\1' || chr(2) || '\2', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(replace(x, chr(2), ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS x FROM documents) SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM s",
    "text_hashes": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS sha, substr(sha256(trim(coalesce(text, ''), ' ' || chr(10) || chr(13) || chr(9))), 1, 16) AS thought FROM documents",
    "subject_context": "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(received?|we got)\\b') THEN 'received' WHEN regexp_matches(text, '(?i)\\b(remit|send|wire|transfer|please\\s+pay|pay\\s+us|kindly\\s+(send|wire|pay))\\b') THEN 'remit' ELSE 'plain' END AS context FROM conversations",
}

ORACLES = {name: BASE + sql for name, sql in LEDGER.items()} | OTHER
