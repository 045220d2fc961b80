"""Column expressions that clean the portals' text, numbers and dates.  All run in the JVM.

A value that is asked about many times is bound once (:func:`bound`): written out at each place, a plan holds it
at each place too, and a row computes it there again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" on the portals.
NO_VALUE = (
    "no definido", "no definida", "no informada", "no informado", "no aplica", "no disponible", "sin definir", "sin dato",
    "s/d", "n/d", "n/a", "na", "none", "null", "-", "--",
)
# What a currency label holds, in the order of precedence.
CURRENCY_MARKS = (
    ("ARS", ("ARS", "PESO ARGENTINO")), ("USD", ("USD", "DOLAR ESTADOUNIDENSE", "US$")), ("EUR", ("EUR",)), ("GBP", ("GBP", "LIBRA ESTERLINA")),
    ("BRL", ("BRL", "REAL")), ("CHF", ("CHF", "FRANCO SUIZO")), ("JPY", ("JPY", "YEN JAPONES")),
)
# Words for yes and no.
YES, NO = ("si", "sí", "yes", "true", "1", "x"), ("no", "false", "0", "")
# Date and time formats in the order they are tried.
DATETIME_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy h:m:s a", "d/M/yyyy h:m a", "d/M/yyyy H:m 'Hrs.'", "d/M/yyyy H:m 'Hrs'", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m")
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d")
_SPACES = "[\\s\\u00a0]+"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """Whitespace and non-breaking spaces collapsed; empty texts and placeholders become null."""
    spaced = F.regexp_replace(c, "&nbsp;?", " ")
    flat = F.regexp_replace(F.regexp_replace(spaced, _SPACES, " "), "^ | $", "")
    return bound(flat, lambda x: F.when((x != "") & ~F.lower(x).isin(*NO_VALUE), x))


def digits_or_null(c: Column) -> Column:
    only = F.regexp_replace(c, "[^0-9]", "")
    return F.when(only != "", only)


def clean_cuit(c: Column) -> Column:
    """A tax id's digits."""
    return digits_or_null(c)


def normalize_name(c: Column) -> Column:
    return clean_text(F.upper(c))


def normalize_currency(c: Column) -> Column:
    """A currency code where the label names one, else the cleaned label.  A label that is a code is not looked into."""

    def code(plain: Column) -> Column:
        out = F.when(plain == "$", F.lit("ARS"))
        for name, marks in CURRENCY_MARKS:
            hit = F.contains(plain, F.lit(marks[0]))
            for m in marks[1:]:
                hit = hit | F.contains(plain, F.lit(m))
            out = out.when(hit, F.lit(name))
        return out

    named = lambda text: F.coalesce(bound(F.translate(F.upper(text), "ÁÉÍÓÚ", "AEIOU"), code), text)
    codes = [name for name, _ in CURRENCY_MARKS]
    return bound(c, lambda label: F.when(label.isNull() | label.isin(codes), label).otherwise(bound(clean_text(label), named)))


def parse_number_ar(c: Column) -> Column:
    """'1.350.000,00' as 1350000.0; a sign is lost, as at the source."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\.", ""), ",", "."), "[^0-9.]", "")
    return F.when(plain != "", plain).try_cast("double")


def parse_int(c: Column) -> Column:
    return digits_or_null(c).try_cast("bigint")


def parse_bool_es(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


# What a text must look like to be tried with a format; no text looks like two of them.
_DAY, _DASHED = "^[0-9]+/[0-9]+/[0-9]+", "^[0-9]+-[0-9]+-[0-9]+"
_SHAPES = (
    (f"{_DAY} [0-9]+:[0-9]+:[0-9]+$", 0), (f"{_DAY} [0-9]+:[0-9]+$", 1), (f"{_DAY} [0-9]+:[0-9]+:[0-9]+ [AP]M$", 2), (f"{_DAY} [0-9]+:[0-9]+ [AP]M$", 3),
    (f"{_DAY} [0-9]+:[0-9]+ Hrs\\.$", 4), (f"{_DAY} [0-9]+:[0-9]+ Hrs$", 5), (f"{_DASHED}T[0-9]+:[0-9]+:[0-9]+$", 6), (f"{_DASHED}T[0-9]+:[0-9]+$", 7),
)


def _moment(text: Column) -> Column:
    """The one format that a cleaned text can have is tried."""
    meridiem = F.regexp_replace(F.regexp_replace(text, "(?i)a\\s*\\.\\s*m\\s*\\.|\\bam\\b", "AM"), "(?i)p\\s*\\.\\s*m\\s*\\.|\\bpm\\b", "PM")

    def parsed(x: Column) -> Column:
        out = None
        for shape, n in _SHAPES:
            at = F.try_to_timestamp(x, F.lit(DATETIME_FORMATS[n]))
            out = F.when(x.rlike(shape), at) if out is None else out.when(x.rlike(shape), at)
        return out

    return bound(meridiem, parsed)


def parse_datetime_ar(c: Column) -> Column:
    return bound(clean_text(c), _moment)


def parse_date_ar(c: Column) -> Column:
    of = lambda x, n: F.try_to_timestamp(x, F.lit(DATE_FORMATS[n]))
    return F.to_date(bound(clean_text(c), lambda x: F.when(x.rlike(f"{_DAY}$"), of(x, 0)).when(x.rlike(f"{_DASHED}$"), of(x, 1)).otherwise(_moment(x))))


def split_process_number(c: Column) -> Column:
    """Struct (saf_code, sequence, type_code, year, saf int), all null where the number has another form."""
    form = "^([0-9/]+)-([0-9]+)-([A-Z]+)([0-9]{2})$"
    text = F.trim(c)
    part = lambda n: F.when(text.rlike(form), F.regexp_extract(text, form, n))
    saf = F.split(part(1), "/")[0]
    return F.struct(part(1).alias("saf_code"), part(2).alias("sequence"), part(3).alias("type_code"), part(4).alias("year"), F.when(saf != "", saf).try_cast("int").alias("saf"))


def split_unit_code(c: Column) -> Column:
    """Struct (code, name): a leading code of joined digit groups, else what stands before ' - ', else all."""
    form = "(?s)^\\s*([0-9]+(?:[/-][0-9]+)+)\\s*[-–—]?\\s*(.*)$"
    coded, dashed = c.rlike(form), F.contains(c, F.lit(" - "))
    code = F.when(coded, F.regexp_extract(c, form, 1)).when(dashed, F.regexp_extract(c, "(?s)^(.*?) - ", 1)).otherwise(c)
    name = F.when(coded, F.regexp_extract(c, form, 2)).when(dashed, F.regexp_extract(c, "(?s)^.*? - (.*)$", 1))
    return F.struct(clean_text(code).alias("code"), clean_text(name).alias("name"))


def name_key(c: Column) -> Column:
    """Lower case without accents or anything but letters and digits: how names are matched."""
    return F.regexp_replace(F.translate(F.lower(c), "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc"), "[^a-z0-9]", "")


def contact_key(kind: Column, value: Column) -> Column:
    """Phones by digits, all else (and phones without digits) in lower case."""
    low = F.lower(F.trim(value))
    return F.when(kind == "Phone", F.coalesce(digits_or_null(value), low)).otherwise(low)
