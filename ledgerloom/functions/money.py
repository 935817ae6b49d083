"""Money in integer cents: SQL expressions that stay in the JVM. A null is a value that can't be read."""

from __future__ import annotations

# The accepted forms of a dollar figure.
DOLLARS = r"^-?\$? *(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?$"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Bind a value that ``body`` uses more than once.

    The value is the start of an aggregation over nothing, and ``body`` its end: unlike an element of an
    array, neither is put into one or copied, which in nested bodies costs more than the work.
    """
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, e0_) -> {name}, {name} -> {body})"


def render_column(cents: str) -> str:
    """render() of a column or a bound name, which costs nothing to name again: no lambda, so that all of it is compiled."""
    return f"concat(if({cents} < 0, '-', ''), '$', format_number(abs({cents}) div 100, 0), '.', lpad(cast(abs({cents}) % 100 as string), 2, '0'))"


def render(cents: str) -> str:
    """$1,250.00 or -$150.00. Exact for all longs but the smallest."""
    return let(cents, "m_", render_column("m_"))


def parse_dollars(text: str) -> str:
    """Cents of a figure in one of the accepted forms, else null; one decimal digit counts tenths."""
    body = "regexp_replace(t_, '[-$, ]', '')"
    cents = let(f"split({body}, '\\\\.')", "p_", "try_add(try_multiply(try_cast(p_[0] as bigint), 100L), try_cast(rpad(if(size(p_) > 1, p_[1], '0'), 2, '0') as bigint))")
    return let(f"cast({text} as string)", "t_", f"if(t_ rlike {quoted(DOLLARS)}, {cents} * if(startswith(t_, '-'), -1L, 1L), cast(null as bigint))")


def whole_percent(part: str, total: str) -> str:
    """Integer percent, halves to even; null if part < 0 or total <= 0."""
    up = "case when 2 * (100 * p_ % q_) > q_ then 1 when 2 * (100 * p_ % q_) < q_ then 0 else (100 * p_ div q_) % 2 end"
    return let(f"cast({part} as bigint)", "p_", let(f"cast({total} as bigint)", "q_", f"if(p_ < 0 or q_ <= 0, cast(null as bigint), 100 * p_ div q_ + {up})"))


def percent(part: str, total: str) -> str:
    """NN%, rounded down; n/a without a total."""
    return f"if({total} <= 0, 'n/a', concat(cast(100 * {part} div {total} as string), '%'))"


def ratio(part: str, total: str) -> str:
    return f"concat(cast({part} as string), '/', cast({total} as string), ' (', {percent(part, total)}, ')')"


def delta(now: str, before: str) -> str:
    return let(f"{now} - {before}", "d_", "concat(if(d_ > 0, '+', ''), cast(d_ as string))")


def points(part1: str, total1: str, part2: str, total2: str) -> str:
    """Difference of two percentages, each rounded down first."""
    return f"if({total1} <= 0 or {total2} <= 0, 'n/a', concat({delta(f'(100 * {part2} div {total2})', f'(100 * {part1} div {total1})')}, 'pp'))"
