"""Text and value expressions. Everything here is a Column, so Catalyst sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that the reference results treat as a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: every character that counts as white space at either end of a text.
WHITE_SPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Accepted date layouts: the part before the time, and how to write it the ISO way (None: as it stands).
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
DATE_LAYOUTS = (
    (rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}})({_TIME})$", None),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})({_TIME})$", "$3-$1-$2$4"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})({_TIME})$", "$1-$2-$3$4"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})({_TIME})$", "$1-$2-$3$4"),
)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks.

    Most texts begin and end with a printable ASCII character: comparing these is cheaper than to trim.
    """
    bare = text.between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def clean(text: Column) -> Column:
    """Strip, and turn what is left empty into null."""
    return F.nullif(strip(text), F.lit(""))


def missing_tokens_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def to_number(text: Column) -> Column:
    """A double, or null where the text is not a number."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_utc(text: Column) -> Column:
    """A timestamp by the first layout that fits, or null. Sessions run in UTC.

    The layouts are rewritten to ISO and cast: unlike ``try_to_timestamp`` per layout,
    a text that does not fit costs no exception.
    """
    iso = F.lit(None).cast("string")
    for pattern, form in reversed(DATE_LAYOUTS):
        written = text if form is None else F.regexp_replace(text, pattern, form)
        iso = F.when(text.rlike(pattern), written).otherwise(iso)
    return iso.try_cast("timestamp")


def signed_log1p(number: Column) -> Column:
    return F.signum(number) * F.log1p(F.abs(number))


def shown(value: Column) -> Column:
    """How a value appears in evidence: null as <NA>."""
    return F.coalesce(value.cast("string"), F.lit("<NA>"))


def shown_time(moment: Column) -> Column:
    return F.coalesce(
        F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), F.lit("<NA>")
    )


def plain_number(number: Column) -> Column:
    """At most six decimals without an exponent or trailing zeros, for JSON text.

    Rounds the value, not its shortest decimal text, which would turn 0.49999999999 of a
    unit into a half; beyond 2^53 millionths there is nothing left to round.
    """
    millionths = F.rint(number * 1000000).cast("decimal(32,0)")
    text = F.when(
        F.abs(number) < 9e9, (millionths * F.lit("0.000001").cast("decimal(6,6)")).cast("string")
    ).otherwise(number.cast("decimal(38,6)").cast("string"))
    trimmed = F.rtrim(text, F.lit("0"))
    return F.when(F.endswith(trimmed, F.lit(".")), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def json_list(texts: Column) -> Column:
    """``["a", "b"]`` with the blank after each comma."""
    return F.when(F.size(texts) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.array_join(texts, '", "'), F.lit('"]'))
    )


def md5_of(*parts: Column | str | int) -> Column:
    """Hash of the parts joined by ``|``: a reproducible order that SQL can repeat."""
    columns = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    return F.md5(F.concat_ws("|", *[column.cast("string") for column in columns]))


def digest_long(text: Column, limit: int = 64) -> Column:
    """Texts over ``limit`` characters as SHA-256, so grouping moves 64 bytes, not the text."""
    return F.when(F.length(text) > limit, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(
        text
    )
