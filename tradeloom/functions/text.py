"""Text and number cleaning as column expressions (no Python functions per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions.rules import contains_any, first_match

MONEY = "decimal(38,0)"
QUANTITY = "decimal(38,10)"

#: i: ignore case, U: Unicode classes, d: only \n ends a line
FLAGS = "(?iUd)"


def strip(text: Column) -> Column:
    """Remove blanks of any kind on both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_field(body: Column, labels: str, value: str) -> Column:
    """Value after the first ``label:`` (ASCII or full-width colon)."""
    return blank_to_null(strip(F.regexp_extract(body, rf"{FLAGS}(?:{labels})\s*[:：]\s*({value})", 1)))


def tax_code_field(body: Column) -> Column:
    return first_field(body, r"MST|Mã\s*số\s*thuế", r"\d{8,13}")


def customer_field(body: Column) -> Column:
    return first_field(body, r"Đại\s*lý|Khách\s*hàng|Đơn\s*vị", r".+")


def address_field(body: Column) -> Column:
    return first_field(body, r"Địa\s*chỉ", r".+")


def phone_field(body: Column) -> Column:
    return first_field(body, r"Liên\s*hệ|SĐT|Điện\s*thoại", r"[\d\s\.\-]+")


def date_field(body: Column) -> Column:
    return blank_to_null(F.regexp_extract(body, FLAGS + r"ngày\s*(\d{2}/\d{2}/\d{4})", 1))


def clean_money(text: Column) -> Column:
    """Digits only; both separators are grouping marks; nothing left gives 0."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def clean_quantity(text: Column) -> Column:
    """A comma is the decimal mark only when there is no dot; failures give 0."""
    kept = F.regexp_replace(text, r"[^0-9,.]", "")
    number = F.when(kept.contains(",") & ~kept.contains("."), F.translate(kept, ",", ".")).otherwise(
        F.regexp_replace(kept, ",", "")
    )
    return F.coalesce(number.try_cast(QUANTITY), F.lit(0).cast(QUANTITY))


def last_total(body: Column) -> Column:
    """Last amount after a total label, cleaned; 0 when there is none."""
    amounts = F.regexp_extract_all(
        body, F.lit(FLAGS + r"(?:Tổng\s*tiền|trị\s*giá)\s*([0-9.,]+)\s*(?:đồng|VND)?"), F.lit(1)
    )
    return clean_money(F.try_element_at(amounts, F.lit(-1)))


def is_bare_code(stripped: Column) -> Column:
    """``is_product_code`` for text without blanks on its ends."""
    return F.coalesce(stripped.rlike(r"^[A-Za-z0-9][A-Za-z0-9.]{5,25}\z"), F.lit(False))


def is_product_code(text: Column) -> Column:
    return is_bare_code(strip(text))


def title_case(text: Column) -> Column:
    """Capital letter after every character that is neither letter nor digit.

    A letter without a single capital (``ß``) stays, as in a letter-by-letter conversion.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))

    def capital(word: Column) -> Column:
        first = F.substring(word, 1, 1)
        upper = F.upper(first)
        rest = F.substring(word, F.lit(2), F.length(word))
        return F.concat(F.when(F.length(upper) == 1, upper).otherwise(first), rest)

    return F.array_join(F.transform(words, capital), "")


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Constant lookup; values that are not listed stay."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


def base_color(color: Column, mapping: dict[str, str] | None = None, unknown: str | None = None) -> Column:
    """Detailed colour to base colour. ``unknown`` labels NULL and empty colours."""
    out = recode(strip(color), mapping or params.BASE_COLORS)
    return out if unknown is None else F.coalesce(blank_to_null(out), F.lit(unknown))


def color_from_name(name: Column, raw: Column, words=None, unknown: str = params.UNKNOWN_LABEL) -> Column:
    """First colour word in the name, else the raw colour, else ``unknown``."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    rules = [(lower.contains(w), color) for w, color in words or params.COLOR_WORDS]
    return first_match(rules, F.coalesce(blank_to_null(raw), F.lit(unknown)))


def normalize_key(text: Column, noise: list[str] | None = None) -> Column:
    """Lower case letters and digits without the noise words."""
    key = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), noise or params.KEY_NOISE, key)


def build_product_name(
    line_name: Column, color: Column, raw_name: Column, prefix: str, drop: str = params.LICENSE_LITERAL
) -> Column:
    """``prefix line colour`` where the line is known, else the raw name."""
    line = strip(F.replace(line_name, F.lit(drop), F.lit("")))
    return F.when(line_name.isNotNull(), strip(F.concat_ws(" ", F.lit(prefix), line, color))).otherwise(raw_name)


def normalize_id(text: Column) -> Column:
    """``12.0`` -> ``12``; text that is no number stays."""
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def normalize_so_number(text: Column) -> Column:
    return F.translate(text, "_", ".")


def order_date_cascade(order_date: Column, mail_date: Column, subject: Column, received: Column) -> Column:
    """First usable of: document date, mail date, date in the subject, time of receipt."""
    in_subject = F.regexp_extract(subject, r"(\d{2}/\d{2}/\d{4})", 1)
    fmt = "dd/MM/yyyy"
    return F.coalesce(
        F.try_to_date(order_date, fmt),
        F.try_to_date(mail_date, fmt),
        F.try_to_date(in_subject, fmt),
        received.cast("date"),
    )


def has_damaged_token(name: Column) -> Column:
    return F.coalesce(contains_any(F.lower(name), params.DAMAGED_TOKENS), F.lit(False))


def question_route(text: Column) -> Column:
    """``forecast`` when a forecast word and no history word occurs, else ``history``."""
    lower = F.lower(text)
    wanted = contains_any(lower, params.FORECAST_WORDS) & ~contains_any(lower, params.HISTORY_WORDS)
    return F.when(wanted, F.lit("forecast")).otherwise(F.lit("history"))
