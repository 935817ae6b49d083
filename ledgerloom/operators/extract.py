"""Claims of drafted replies: all detectors of a sentence run in its own row, as array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, quoted
from ledgerloom.functions.text import ANY_CASE, EXPLICIT_ID, LOOSE_ID, MONTH, MONTHS, NUMBER_WORD, UNICODE, amount_cents, found, matches, mention_id, sentences

# What the detectors look for, amounts and dates in order of priority; each with what any match contains, in lower case.
AMOUNTS = (  # the last field: whether a match holds a digit
    ("resolvable", UNICODE, r"-?\$\s?\d+(?:,\d{3})*(?:\.\d{1,2})?", ("$",), True),
    ("resolvable", ANY_CASE, r"\bUSD\s*-?\d+(?:,\d{3})*(?:\.\d{1,2})?\b", ("usd",), True),
    ("resolvable", ANY_CASE, r"-?\b\d+(?:,\d{3})*(?:\.\d{1,2})?\s*(?:dollars?|USD)\b", ("dollar", "usd"), True),
    ("resolvable", ANY_CASE, rf"\b(?:(?:{NUMBER_WORD})(?:[\s-]+(?:and[\s-]+)?(?:{NUMBER_WORD}))*)\s+dollars\b", ("dollars",), False),
    ("unverifiable", ANY_CASE, r"\b\d+(?:\.\d+)?\s?(?:%|percent\b)", ("%", "percent"), True),
    ("unverifiable", ANY_CASE, r"\b(?:(?:a|one|two|three)\s+)?(?:half|third|quarter)s?\s+of\s+(?:the\s+|this\s+|that\s+|your\s+)?(?:invoice|balance|total|amount|(?:INV|PMT|CM)-\d+)", ("half", "third", "quarter"), False),
    ("resolvable", UNICODE, r"-?\b\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\b", (",",), True),
    ("resolvable", UNICODE, r"-?\b\d+\.\d{2}\b", (".",), True),
)
DATES = (
    (UNICODE, r"\b\d{4}-\d{2}-\d{2}\b", ("-",)),
    (ANY_CASE, rf"\b(?:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", tuple(sorted({m[:3] for m in MONTHS}))),
    (UNICODE, r"\b\d{1,2}/\d{1,2}/\d{4}\b", ("/",)),
)
TOTAL = r"\b(?:your\s+account|the\s+account|account\s+balance|net\s+balance|total\s+balance|balance\s+due\s+on|total\s+amount\s+due|total\s+due|grand\s+total|in\s+total|altogether|combined|total)\b"
ROLES = (  # of equally near ones the first
    ("original", r"\b(?:originally|original\s+amount|issued\s+for|was\s+(?:issued\s+)?for|billed\s+(?:for|at)|invoiced\s+(?:for|at)|face\s+value|full\s+amount)\b"),
    ("applied", r"\b(?:paid|applied|remitted|of\s+which)\b"),
    ("open", r"\b(?:open|remaining|remains|outstanding|still\s+due|now\s+due|currently\s+due|amount\s+due|balance\s+due|balance\s+of|left|owing|owed|due)\b"),
)
SUM = r"\b(?:total|balance\s+(?:due|of|is)|amount\s+due|owes?|owed|owing)\b"
OF_BALANCE = r"of\s+(?:the\s+|this\s+|that\s+|your\s+)?(?:balance|total|amount|account)\b"
ITEMS = r"\b(?:invoices?|line\s+items?|open\s+items?)\b"
STATUS = r"\b(past\s+due|unpaid|paid|outstanding|overdue|settled|cleared)\b"
PAID = r"\b(?:taken\s+care\s+of|paid\s+off|paid\s+in\s+full|settled\s+in\s+full|cleared\s+up|nothing\s+(?:further\s+)?(?:is\s+)?owed|no\s+longer\s+owed?|fully\s+paid)\b"
DECOMPOSED = r"\b(?:originally|original\s+amount|of\s+which|leaving|partial(?:ly)?)\b"
FUZZY = r"\b(?:approved?|approval|agreed?|agreement|waiv(?:e|ed|er|ing)|promis(?:e|ed|es|ing)|confirm(?:s|ed|ing)?|discuss(?:ed|es|ing|ion)?|arrang(?:e|ed|es|ing|ement)|spoke|spoken|told|call(?:ed)?|account\s+manager|as\s+we\s+discussed|per\s+our\s+conversation|taken\s+care\s+of|paid\s+off|settled\s+in\s+full|nothing\s+(?:further\s+)?(?:is\s+)?owed|no\s+longer\s+owed?)\b"
BEFORE, AFTER = 32, 24  # characters around an amount in which words govern it
UNRESOLVED = "the token can't be resolved to cents; escalated, not dropped"

_KEPT = "array<struct<start:int,end:int,token:string,kind:string>>"
_STRINGS = "cast(array() as array<string>)"
_TEXT = "coalesce(draft, '')"
_NO_MATCH = "cast(array() as array<struct<start:int,end:int,token:string>>)"
#: A sentence in lower case, as patterns without case see it: of letters beyond ASCII only these four fold to it.
_LOW = "lower(if(octet_length(s) = length(s), s, translate(s, '\u017f\u0131\u0130\u212a', 'siik')))"
#: What a match of each of these patterns contains, in lower case.
STATUS_NEEDS, PAID_NEEDS = ("due", "paid", "outstanding", "settled", "cleared"), ("taken", "paid", "settled", "cleared", "owe")
EXPLICIT_NEEDS, LOOSE_NEEDS, TOTAL_NEEDS = ("inv", "pmt", "cm"), ("invoice", "payment", "credit"), ("account", "balance", "total", "altogether", "combined")
ROLE_NEEDS = {"original": ("original", "for", "billed", "invoiced", "face", "full"), "applied": ("paid", "applied", "remitted", "which"), "open": ("open", "remain", "outstanding", "due", "balance", "left", "ow")}
FUZZY_NEEDS = ("approv", "agree", "waiv", "promis", "confirm", "discuss", "arrang", "spoke", "told", "call", "account", "conversation", "taken", "paid", "settled", "owe")


def _may(needs: tuple[str, ...]) -> str:
    """Whether a sentence has anything that a match contains."""
    return " or ".join(f"contains(low, {quoted(x)})" for x in needs)


def _matches(pattern: str, flags: str, needs: tuple[str, ...], none: str = _NO_MATCH, digits: bool = False) -> str:
    """All matches in s; a sentence without anything that a match contains, or without a digit if one must, isn't searched."""
    return f"if({'digit and ' if digits else ''}({_may(needs)}), {matches('s', pattern, flags)}, {none})"


def _tagged(flags: str, pattern: str, kind: str, needs: tuple[str, ...], digits: bool = True) -> str:
    """_matches() with their kind."""
    return f"transform({_matches(pattern, flags, needs, digits=digits)}, h_ -> named_struct('start', h_.start, 'end', h_.end, 'token', h_.token, 'kind', '{kind}'))"


def _claimed(candidates: str, already: str) -> str:
    """Keep each match, in order of priority, that overlaps none kept before."""
    return f"aggregate({candidates}, cast({already} as {_KEPT}), (k_, m_) -> if(exists(k_, o_ -> m_.start < o_.end and m_.end > o_.start), k_, concat(k_, array(m_))))"


def _nearest(pos: str) -> str:
    """The last document named at or before a place, else the first after it; null if none."""
    return f"coalesce(try_element_at(filter(ids, j_ -> j_.pos <= {pos}), -1).id, get(filter(ids, j_ -> j_.pos > {pos}), 0).id)"


def _distance(pattern: str, needs: tuple[str, ...]) -> str:
    """How far from the amount the nearest match in its window is; null if there is none."""
    gap = "if(q_.start + lo < a.end and q_.end + lo > a.start, 0, least(abs(q_.start + lo - a.end), abs(a.start - (q_.end + lo))))"
    return f"if({_may(needs)}, array_min(transform({matches('near', pattern, ANY_CASE)}, q_ -> {gap})), cast(null as int))"


def _detected() -> str:
    """SQL: what is in a sentence s, given known (ids of the ledger): struct of s, ids (mentions in order), amounts and dates (disjoint spans in order)."""
    mention = f"concat({_matches(EXPLICIT_ID, ANY_CASE, EXPLICIT_NEEDS, digits=True)}, {_matches(LOOSE_ID, ANY_CASE, LOOSE_NEEDS, digits=True)})"
    ids = f"sort_array(transform({mention}, n_ -> named_struct('pos', n_.start, 'id', {mention_id('n_.token', 'known')})))"
    amounts = "concat(" + ", ".join(_tagged(flags, p, kind, needs, digits) for kind, flags, p, needs, digits in AMOUNTS) + ")"
    dates = "concat(" + ", ".join(_tagged(flags, p, "date", needs) for flags, p, needs in DATES) + ")"
    told = f"named_struct('s', s, 'ids', {ids}, 'amounts', sort_array(kept), 'dates', sort_array(filter({_claimed(dates, 'kept')}, m_ -> m_.kind = 'date')))"
    return let(found("s", r"\d", UNICODE), "digit", let(_LOW, "low", let(_claimed(amounts, "array()"), "kept", told)))


def detect(drafts: DataFrame) -> DataFrame:
    """draft_id, docs, sent, s, ids, amounts, dates: a row for each sentence. drafts: draft_id, draft, docs (see ledger.view)."""
    rows = drafts.select("draft_id", F.transform("docs", lambda d: d["id"]).alias("known"), F.posexplode(F.expr(sentences("coalesce(draft, '')"))).alias("sent", "s"))
    return rows.withColumn("f", F.expr(_detected())).select("draft_id", "sent", "f.*")


def _claim(kind: str, pos: str, rank: int, token: str, subjects: str = _STRINGS, role: str = "''", preset: str = "cast(null as string)", turn: str = "0", cents: str = "cast(null as bigint)") -> str:
    """A claim as a struct; the first five fields are the order of reading."""
    return f"named_struct('sent', sent, 'pos', cast({pos} as int), 'rank', {rank}, 'turn', {turn}, 'token', {token}, 'type', {kind}, 'span', s, 'subject_ids', {subjects}, 'role', {role}, 'preset', {preset}, 'cents', {cents})"


def _lets(values: dict[str, str], body: str) -> str:
    """Bind each value to its name, the first outermost."""
    for name, value in reversed(values.items()):
        body = let(value, name, body)
    return body


def _amount_claims() -> str:
    invoices = "transform(filter(ids, j_ -> startswith(j_.id, 'INV-')), j_ -> j_.id)"
    bound = {
        "lo": f"greatest(coalesce(array_max(transform(filter(amounts, o_ -> o_.end <= a.start), o_ -> o_.end)), 0), a.start - {BEFORE})",
        "hi": f"least(coalesce(array_min(transform(filter(amounts, o_ -> o_.start >= a.end), o_ -> o_.start)), length(s)), a.end + {AFTER})",
        "near": "substring(s, lo + 1, hi - lo)", "total_gap": _distance(TOTAL, TOTAL_NEEDS), **{f"{role}_gap": _distance(p, ROLE_NEEDS[role]) for role, p in ROLES}, "gap": "least(" + ", ".join(f"{role}_gap" for role, _ in ROLES) + ")",
        "total": "total_gap is not null and (gap is null or total_gap <= gap)",
        "before": "try_element_at(filter(ids, j_ -> j_.pos <= a.start), -1).id", "after": "get(filter(ids, j_ -> j_.pos > a.start), 0).id",
        "how": f"case when before is not null and not total then 'before' when total or {found('near', SUM)} or {found('near', OF_BALANCE)} then 'sum' when after is not null then 'after' else 'none' end",
        "cents": amount_cents("a.token"),
    }
    word = "case " + " ".join(f"when {role}_gap = gap then '{role}'" for role, _ in ROLES) + " else '' end"
    subjects = f"case how when 'before' then array(before) when 'after' then array(after) when 'sum' then if(size({invoices}) >= 2 and {found('s', ITEMS)}, {invoices}, {_STRINGS}) else {_STRINGS} end"
    preset = "if(a.kind = 'unverifiable' or cents is null, 'unverifiable', cast(null as string))"
    claim = _claim("if(how = 'sum', 'C-SUM', 'C-AMT')", "a.start", 1, "a.token", subjects, f"case how when 'sum' then 'total' when 'none' then '' else {word} end", preset, cents="cents")
    return f"transform(amounts, a -> {_lets(bound, claim)})"


def _date_claims() -> str:
    start = "coalesce(array_max(transform(filter(concat(amounts, dates), o_ -> o_.end <= d.start), o_ -> o_.end)), 0)"
    within = "transform(filter(ids, j_ -> j_.pos >= since and j_.pos < d.start), j_ -> j_.id)"
    alone = "size(filter(dates, o_ -> o_.start >= since and o_.start <= d.start)) <= 1"
    near = let(_nearest("d.start"), "n_", f"if(n_ is null, {_STRINGS}, array(n_))")
    claim = _claim("'C-DATE'", "d.start", 2, "d.token", f"if({alone} and size({within}) >= 1, {within}, {near})")
    return f"transform(dates, d -> {let(start, 'since', claim)})"


def _status_claims() -> str:
    words = f"filter({_matches(STATUS, ANY_CASE, STATUS_NEEDS)}, w_ -> not ({found('s', DECOMPOSED)} and lower(w_.token) in ('paid', 'unpaid')))"
    hits = f"concat(transform({words}, w_ -> named_struct('pos', w_.start, 'word', w_.token, 'turn', 0)), transform({_matches(PAID, ANY_CASE, PAID_NEEDS)}, w_ -> named_struct('pos', w_.start, 'word', 'paid', 'turn', 1)))"
    claim = _claim("'C-STATUS'", "h.pos", 3, "h.word", f"array({_nearest('h.pos')})", turn="h.turn")
    return f"if(size(ids) > 0, transform({hits}, h -> {claim}), slice(array({_claim(quoted('C-STATUS'), '0', 3, quoted(''))}), 1, 0))"


def _sentence_claims() -> str:
    """SQL: all claims of a sentence s, the sent-th of its draft, given known."""
    exist = f"transform(ids, i -> {_claim(quoted('C-EXIST'), 'i.pos', 0, 'i.id')})"
    fuzzy = f"transform(slice({_matches(FUZZY, ANY_CASE, FUZZY_NEEDS)}, 1, 1), v_ -> {_claim(quoted('C-FUZZY'), 'v_.start', 4, quoted(''))})"
    every = f"concat({exist}, {_amount_claims()}, {_date_claims()}, {_status_claims()}, {fuzzy})"
    seen = {"low": _LOW, "ids": "f.ids", "amounts": "f.amounts", "dates": "f.dates"}
    return let(_detected(), "f", _lets(seen, every))


def _in_order(found: str, *more: str) -> str:
    """SQL: claims in order of reading, each once and numbered; more: further fields of theirs to keep."""
    key = "concat_ws('\\u0001', c_.type, if(c_.type = 'C-EXIST', '', c_.span), c_.token, array_join(c_.subject_ids, ','), c_.role)"
    sorted_keys = f"sort_array(transform(all_, (c_, i_) -> named_struct('key', {key}, 'i', i_)))"
    firsts = let(sorted_keys, "keys", "sort_array(transform(filter(keys, (k_, i_) -> i_ = 0 or k_.key <> keys[i_ - 1].key), k_ -> k_.i))")
    once = f"transform({firsts}, p_ -> all_[p_])"
    own = "".join(f", '{name}', c_.{name}" for name in more)
    shown = f"named_struct('n', i_ + 1, 'claim_id', concat('c-', lpad(cast(i_ + 1 as string), 3, '0')), 'type', c_.type, 'span', c_.span, 'token', c_.token, 'subject_ids', c_.subject_ids, 'subject_id', if(size(c_.subject_ids) = 1, c_.subject_ids[0], ''), 'role', c_.role, 'preset', c_.preset, 'cents', c_.cents{own})"
    return let(found, "all_", f"transform({once}, (c_, i_) -> {shown})")


def claims_in_rows(drafts: DataFrame) -> DataFrame:
    """drafts (draft, docs and others) with ``claims``, an array of structs as in extract_claims() with cents; empty for a null or empty draft.

    All of a draft stays in its own row, so that no text or ledger is shuffled or written.
    """
    each = f"transform({sentences(_TEXT)}, (s, sent) -> {_sentence_claims()})"
    rows = drafts.withColumn("claims", F.expr(f"sort_array(flatten({let('transform(docs, d_ -> d_.id)', 'known', each)}))"))
    return rows.withColumn("claims", F.expr(_in_order("claims")))


def found_in_texts(rows: DataFrame) -> DataFrame:
    """rows (texts, an array of structs with a text, and docs) with what their texts say: told, said and found.

    told: each text's sentences; said: those of all texts, each once; found: the claims in each of these,
    in order. So what texts of one scenario have in common is searched once.
    """
    rows = rows.withColumn("told", F.expr(f"transform(texts, t_ -> array_distinct({sentences(_TEXT.replace('draft', 't_.text'))}))")).withColumn("said", F.expr("array_distinct(flatten(told))"))
    each = f"transform(said, s -> {let('0', 'sent', f'sort_array({_sentence_claims()})')})"
    return rows.withColumn("found", F.expr(let("transform(docs, d_ -> d_.id)", "known", each)))


def claims_of_texts(rows: DataFrame) -> DataFrame:
    """rows of found_in_texts() with a result in each claim, as a row for each text: the columns but texts, then its fields, and claims.

    A sentence that comes again makes no new claim, so each counts where it first comes.
    """
    own = "flatten(transform(x_, s_ -> found_[cast(array_position(said_, s_) as int) - 1]))"
    each = f"transform(told, x_ -> {_in_order(own, 'result')})"
    rows = rows.withColumn("claims_of", F.expr(_lets({"said_": "said", "found_": "found"}, each)))  # named outside: a column named once would be computed where it is named, for each sentence
    kept = [c for c in rows.columns if c not in ("texts", "told", "said", "found", "claims_of")]
    each = rows.select(*kept, F.explode_outer(F.arrays_zip("texts", "claims_of")).alias("t_")).where("t_ is not null")  # an inner one would be tested first, see each_claim()
    return each.select(*kept, "t_.texts.*", F.col("t_.claims_of").alias("claims"))


def each_claim(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each claim of rows with ``claims``, with these columns of theirs.

    inline() alone would have Spark test first whether there are claims, which finds all of them once
    more, and again for each claim that is named there; so drafts without claims are left out behind it.
    """
    return rows.select(*keep, F.inline_outer("claims")).where("n is not null")


def extract_claims(drafts: DataFrame) -> DataFrame:
    """Claims in reading order: draft_id, n, claim_id, type, span, token, subject_ids, subject_id, role, preset.

    drafts: draft_id, draft, docs. A document is claimed to exist once a draft, at its first mention;
    other claims that agree in type, span, token, subjects and role are one. preset is the status of
    amounts that can't be read. A null or empty draft has no claims.
    """
    return each_claim(claims_in_rows(drafts), "draft_id").drop("cents")
