"""Text normalisation as column expressions.

Order (T6): dates, numbers, currency, then e-mails and URLs. E-mails and URLs
are both found on the text *before* any lower-casing, then e-mail
replacements are applied, then URL replacements (so a URL that contained a
mixed-case e-mail is no longer found for its own replacement).

Regex classes are ASCII (Java ``\\d``, ``\\s``), see README decisions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex_callback import group, replace_matches

# The patterns normalisation matches.
DATE_RE = r"(\d{1,2})[\-/](\d{1,2})[\-/](\d{2,4})"
NUMBER_RE = r"(?<!\d)(\d{1,3}(?:[.,]\d{3})*)(?:[.,](\d+))?(?!\d)"
CURRENCY_RE = r"(?i)(?:rp|idr)\s*(\d+[\d.,]*)"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_RE = r"https?://\S+"


def norm_dates(text: Column) -> Column:
    """d/m/y with 1-2 digit day and month, 2-4 digit year -> dd-mm-yyyy."""
    return replace_matches(text, DATE_RE, lambda m: F.concat_ws(
        "-",
        F.lpad(group(m, DATE_RE, 1), 2, "0"),
        F.lpad(group(m, DATE_RE, 2), 2, "0"),
        F.lpad(group(m, DATE_RE, 3), 4, "0")))


def _decimal_swap(s: Column) -> Column:
    # delete '.', then ',' -> '.'
    return F.translate(F.translate(s, ".", ""), ",", ".")


def norm_numbers(text: Column) -> Column:
    """Indonesian digit grouping: 1.234,56 -> 1234.56 (per match)."""
    return replace_matches(text, NUMBER_RE, _decimal_swap)


def norm_currency(text: Column) -> Column:
    """(rp|idr) amount -> 'IDR ' + amount without '.', ',' -> '.'."""
    return replace_matches(text, CURRENCY_RE,
                           lambda m: F.concat(F.lit("IDR "), _decimal_swap(group(m, CURRENCY_RE, 1))))


def find_emails(text: Column) -> Column:
    return _all(text, EMAIL_RE, text.contains("@"))


def find_urls(text: Column) -> Column:
    return _all(text, URL_RE, text.contains("://"))


def _all(text: Column, pattern: str, likely: Column) -> Column:
    """All matches; the pattern is run only over texts that hold its fixed part."""
    return F.when(likely, F.regexp_extract_all(text, F.lit(pattern), 0)).when(text.isNotNull(), F.array().cast("array<string>"))


def lower_each(text: Column, found: Column) -> Column:
    """Replace every occurrence of each found string by its lower-case form
    (each distinct string that changes, once)."""
    changing = F.filter(F.array_distinct(found), lambda x: x != F.lower(x))
    return F.when(F.size(changing) > 0, F.aggregate(changing, text, lambda acc, x: F.replace(acc, x, F.lower(x)))).otherwise(text)


def normalize_columns(text: Column) -> dict[str, Column]:
    """T6 as three columns: normalised text, e-mails, URLs (both lower-cased).

    Returned as a dict so callers can ``select`` or ``withColumns`` them.
    The intermediate text is referenced several times; callers that care
    about re-evaluation should materialise ``stage3`` first (see
    ``normalize_frame``).
    """
    stage3 = norm_currency(norm_numbers(norm_dates(text)))
    emails = find_emails(stage3)
    urls = find_urls(stage3)
    out = lower_each(lower_each(stage3, emails), urls)
    return {"text": out,
            "emails": F.transform(emails, F.lower),
            "urls": F.transform(urls, F.lower)}


def normalize_frame(df, text_col: str = "text", out_col: str = "text"):
    """T6 on a DataFrame: adds ``emails`` and ``urls`` and rewrites ``out_col``.

    The date/number/currency stage is computed once into a helper column so
    the two finders and the replacement chain do not re-run it.
    """
    tmp = "__norm_stage3"
    staged = df.withColumn(tmp, norm_currency(norm_numbers(norm_dates(F.col(text_col)))))
    staged = staged.withColumns({"emails": find_emails(F.col(tmp)),
                                 "urls": find_urls(F.col(tmp))})
    staged = staged.withColumn(out_col, lower_each(lower_each(F.col(tmp), F.col("emails")), F.col("urls")))
    staged = staged.withColumns({"emails": F.transform("emails", F.lower),
                                 "urls": F.transform("urls", F.lower)})
    return staged.drop(tmp)
