"""Text functions as SQL expressions: matches with offsets, sentences, amount and date tokens, ids."""

from __future__ import annotations

from ledgerloom.functions.money import let, parse_dollars, quoted

# Vocabularies of number words, months and references.
UNITS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
PREFIXES = {"invoice": "INV", "payment": "PMT", "credit memo": "CM"}
SENTENCE_END = r"(?<=[.!?])(?<!No\.)(?<!no\.)\s+|\n+"
EXPLICIT_ID = r"\b(INV|PMT|CM)[-_ ]?(\d+)\b"
LOOSE_ID = r"\b(invoice|payment|credit\s+memo)\s+(?:no\.?\s*|number\s*)?#?\s*(\d+)\b"

NUMBER_WORD = "|".join(sorted([*UNITS, "hundred", "thousand"], key=lambda w: (-len(w), w)))
MONTH = "|".join(sorted(MONTHS, key=lambda w: (-len(w), w)))
#: The forms of nearly all tokens, which are read without being trimmed and searched first.
COMMON_AMOUNT, COMMON_DATE, COMMON_ID = r"^-?\$[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2}\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", r"(?i)^(?:INV|PMT|CM)[-_ ]?[0-9]+\z"
#: Java flags under which classes and boundaries are those of Unicode; with and without case.
ANY_CASE, UNICODE = "(?iuU)", "(?U)"


def matches(text: str, pattern: str, flags: str = UNICODE) -> str:
    """Array of (start, end, token) of all matches, in order; the text has no U+0001 or U+0002.

    The matches are marked in one pass over the whole text, so boundaries and lookbehinds see it all;
    offsets are sums of the pieces' lengths, in code points.
    """
    marked = f"regexp_replace({text}, {quoted(flags + pattern)}, '\\u0001$0\\u0001')"
    one = "named_struct('start', length(array_join(slice(x_, 1, i_), '')), 'end', length(array_join(slice(x_, 1, i_ + 1), '')), 'token', x_[i_])"
    none = "cast(array() as array<struct<start:int,end:int,token:string>>)"
    split = let(f"split({marked}, '\\u0001')", "x_", f"transform(sequence(1, size(x_) - 2, 2), i_ -> {one})")  # a single character needs no pattern
    return f"if({found(text, pattern, flags)}, {split}, {none})"


def found(text: str, pattern: str, flags: str = ANY_CASE) -> str:
    return f"({text} rlike {quoted(flags + pattern)})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {quoted('(?U)^[' + chr(92) + 's' + chr(92) + 'x1c-' + chr(92) + 'x1f]+|[' + chr(92) + 's' + chr(92) + 'x1c-' + chr(92) + 'x1f]+$')}, '')"


def unmarked(text: str) -> str:
    return f"translate({text}, '\\u0001\\u0002', '')"


def sentences(text: str) -> str:
    """Trimmed, non-empty sentences; a break after No. or inside a figure isn't one."""
    return f"filter(transform(split({unmarked(text)}, {quoted(UNICODE + SENTENCE_END)}), s_ -> {strip('s_')}), s_ -> s_ <> '')"


def strip_thinking(text: str) -> str:
    return strip(f"regexp_replace({text}, '(?s)<think>.*?</think>\\\\s*', '')")


def sha16(text: str) -> str:
    return f"substr(sha2({text}, 256), 1, 16)"


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {v if isinstance(v, int) else quoted(v)}" for k, v in values.items()) + ")"


def words_to_dollars(text: str) -> str:
    """Dollars of a phrase of number words, null if a word isn't one or nothing is left."""
    units = _map(UNITS)
    step = f"""case when b_.bad or w_ = 'and' then b_
        when element_at({units}, w_) is not null then named_struct('total', b_.total, 'now', b_.now + element_at({units}, w_), 'bad', false)
        when w_ = 'hundred' then named_struct('total', b_.total, 'now', if(b_.now = 0, 1L, b_.now) * 100, 'bad', false)
        when w_ = 'thousand' then named_struct('total', b_.total + if(b_.now = 0, 1L, b_.now) * 1000, 'now', 0L, 'bad', false)
        else named_struct('total', 0L, 'now', 0L, 'bad', true) end"""
    words = f"filter(split(lower({text}), {quoted(UNICODE + '[' + chr(92) + 's-]+')}), w_ -> w_ <> '')"
    return f"aggregate({words}, named_struct('total', 0L, 'now', 0L, 'bad', false), (b_, w_) -> {step}, b_ -> if(b_.bad or b_.total + b_.now <= 0, cast(null as bigint), b_.total + b_.now))"


def _edges(text: str) -> str:
    return strip(f"regexp_replace({strip(text)}, '^[.,;:]+|[.,;:]+$', '')")


def amount_cents(token: str) -> str:
    """Cents of any amount token; null for percentages, fractions and what can't be read."""
    plain = strip("regexp_replace(" + strip(f"regexp_replace(e_, {quoted(ANY_CASE + chr(92) + 'b(?:usd|dollars?)' + chr(92) + 'b')}, ' ')") + ", '^,+|,+$', '')")
    read = let(plain, "c_", f"""case when c_ = '' then cast(null as bigint)
        when c_ rlike '(?U)^-?[$]?\\\\s*[\\\\d,]+(?:\\\\.\\\\d{{1,2}})?$' then {parse_dollars('c_')}
        else {words_to_dollars('c_')} * 100 end""")
    vague = r"%|\bpercent\b|\b(?:half|halves|third|thirds|quarter|quarters)\b"
    whole = let(_edges(token), "e_", f"if(lower(e_) rlike {quoted(UNICODE + vague)}, cast(null as bigint), {read})")
    return f"if({token} rlike {quoted(COMMON_AMOUNT)}, try_cast(translate({token}, '$,.', '') as bigint), {whole})"


def date_value(token: str) -> str:
    """The date of an ISO, month-name or month/day/year token; null for others and impossible dates."""
    named = f"^({MONTH})\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})$"
    part = lambda p, i: f"regexp_extract(d_, {quoted(ANY_CASE + p)}, {i})"
    day = lambda y, m, d: f"try_to_date(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    common = f"{token} rlike {quoted(COMMON_DATE)}"
    return f"if({common}, try_to_date({token}, 'yyyy-MM-dd'), " + let(_edges(token), "d_", f"""case when d_ rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then try_to_date(d_, 'yyyy-MM-dd')
        when {found('d_', named)} then {day(part(named, 3), f"cast(element_at({_map(MONTHS)}, lower({part(named, 1)})) as string)", part(named, 2))}
        when {found('d_', slash)} then {day(part(slash, 3), part(slash, 1), part(slash, 2))}
        else cast(null as date) end""") + ")"


def canonical_id(prefix: str, digits: str, ids: str) -> str:
    """prefix-digits if ids has it, else the only id of ids that is equal but for leading zeros, else prefix-digits."""
    same = f"filter({ids}, y_ -> startswith(y_, concat(p_, '-')) and ltrim('0', substr(y_, length(p_) + 2)) = ltrim('0', g_))"
    pick = let("concat(p_, '-', g_)", "e_", f"if(exists({ids}, y_ -> y_ = e_), e_, {let(same, 'z_', 'if(size(z_) = 1, z_[0], e_)')})")
    return let(prefix, "p_", let(digits, "g_", pick))


def loose_prefix(kind: str) -> str:
    return f"element_at({_map(PREFIXES)}, regexp_replace(lower({kind}), {quoted(UNICODE + chr(92) + 's+')}, ' '))"


def mention_id(token: str, ids: str) -> str:
    """The canonical id of a reference of either form, null if it is none."""
    get = lambda p, i: f"regexp_extract(r_, {quoted(ANY_CASE + '^(?:' + p + ')$')}, {i})"
    explicit = canonical_id(f"upper({get(EXPLICIT_ID, 1)})", get(EXPLICIT_ID, 2), ids)
    loose = canonical_id(loose_prefix(get(LOOSE_ID, 1)), get(LOOSE_ID, 2), ids)
    return let(token, "r_", f"case when {found('r_', '^(?:' + EXPLICIT_ID + ')$')} then {explicit} when {found('r_', '^(?:' + LOOSE_ID + ')$')} then {loose} end")


def document_argument(text: str, ids: str) -> str:
    """The canonical id of an argument, or the trimmed argument if it is no reference."""
    return let(strip(text), "v_", f"coalesce({mention_id('v_', ids)}, v_)")


def reference(text: str) -> str:
    """SQL: struct of id, what an argument names before any ledger is asked (PREFIX-digits, or the trimmed argument), and whether it is a reference."""
    get = lambda p, i: f"regexp_extract(v_, {quoted(ANY_CASE + '^(?:' + p + ')$')}, {i})"
    explicit = f"concat(upper({get(EXPLICIT_ID, 1)}), '-', {get(EXPLICIT_ID, 2)})"
    loose = f"concat({loose_prefix(get(LOOSE_ID, 1))}, '-', {get(LOOSE_ID, 2)})"
    read = f"case when {found('v_', '^(?:' + EXPLICIT_ID + ')$')} then {explicit} when {found('v_', '^(?:' + LOOSE_ID + ')$')} then {loose} end"
    whole = let(strip(text), "v_", let(read, "e_", "named_struct('id', coalesce(e_, v_), 'ref', e_ is not null)"))
    letters = f"if(lower(substr({text}, 1, 1)) = 'c', 2, 3)"
    common = f"named_struct('id', concat(upper(substr({text}, 1, {letters})), '-', ltrim('-_ ', substr({text}, {letters} + 1))), 'ref', true)"
    return f"if({text} rlike {quoted(COMMON_ID)}, {common}, {whole})"


def loose_name(id: str) -> str:
    """SQL: the name under which ids meet that are equal but for leading zeros of what follows their prefix."""
    return f"if(instr({id}, '-') > 0, concat(substring_index({id}, '-', 1), '-', ltrim('0', substr({id}, instr({id}, '-') + 1))), {id})"
