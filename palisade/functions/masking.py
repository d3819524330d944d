"""Masking of detected values, one expression per category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REDACTED = "[REDACTED]"
# --- fixed values: placeholders that already stand for hidden text ----------
HIDDEN = (REDACTED, "[REDACTED — abuse content]")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^\p{Nd}]", "")


def _last(v: Column, n: int) -> Column:
    return F.substring(v, -n, n)


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, "[ -]", "")


def mask_generic(v: Column) -> Column:
    n = F.length(v)
    return F.when(n > 6, F.concat(F.substring(v, 1, 3), F.repeat(F.lit("*"), n - 5), _last(v, 2))) \
        .otherwise(F.repeat(F.lit("*"), n))


def mask_partial(v: Column, keep: int, fill: str = "*") -> Column:
    """Only the last ``keep`` digits stay; separators go."""
    d = _digits(v)
    n = F.length(d)
    return F.when(n <= keep, F.repeat(F.lit(fill), n)) \
        .otherwise(F.concat(F.repeat(F.lit(fill), n - keep), _last(d, keep)))


def mask_email(v: Column) -> Column:
    local = F.substring_index(v, "@", 1)
    domain = F.substring(v, F.instr(v, "@") + 1, F.length(v))
    host = F.substring_index(domain, ".", 1)
    rest = F.when(F.contains(domain, F.lit(".")), F.substring(domain, F.length(host) + 2, F.length(domain))).otherwise("")
    masked = F.concat(F.substring(local, 1, 1), F.lit("***@"), F.substring(host, 1, 1), F.lit("***."), rest)
    return F.when(~F.contains(v, F.lit("@")), "***@***.***").when(host == "", mask_generic(v)).otherwise(masked)


def mask_ssn(v: Column) -> Column:
    return F.when(F.length(v) >= 4, F.concat(F.lit("***-**-"), _last(_bare(v), 4))).otherwise("***-**-****")


def mask_aadhaar(v: Column) -> Column:
    return F.when(F.length(v) >= 4, F.concat(F.lit("XXXX XXXX "), _last(_bare(v), 4))).otherwise("XXXX XXXX XXXX")


def mask_pan(v: Column) -> Column:
    return F.when(F.length(v) >= 10, F.concat(F.substring(v, 1, 1), F.lit("XXXX"), F.substring(v, 6, 2147483647))) \
        .otherwise("XXXXX****X")


def mask_passport(v: Column) -> Column:
    return F.when(F.length(v) >= 2, F.concat(F.substring(v, 1, 1), F.lit("XXXXXX"))).otherwise("XXXXXXX")


def mask_card(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d) >= 4, F.concat(F.lit("XXXX-XXXX-XXXX-"), _last(d, 4))).otherwise("XXXX-XXXX-XXXX-XXXX")


def mask_ip(v: Column) -> Column:
    return F.when(F.contains(v, F.lit(".")), F.concat(F.substring_index(v, ".", 2), F.lit(".XXX.XXX"))) \
        .otherwise("X.X.X.X")


def mask_birth_date(v: Column) -> Column:
    return F.when(v.rlike("[/-]"), F.concat(F.lit("XX/XX/"), F.substring_index(F.translate(v, "-", "/"), "/", -1))) \
        .otherwise("XX/XX/XXXX")


def mask_iban(v: Column) -> Column:
    n = F.length(v)
    return F.when(n > 8, F.concat(F.substring(v, 1, 4), F.repeat(F.lit("X"), n - 8), _last(v, 4))).otherwise("XXXXXXXX")


MASKS = {
    "EMAIL": mask_email,
    "PHONE_INDIA": lambda v: mask_partial(v, 2),
    "PHONE_US": lambda v: mask_partial(v, 4),
    "SSN": mask_ssn,
    "AADHAAR": mask_aadhaar,
    "PAN_CARD": mask_pan,
    "PASSPORT": mask_passport,
    "CREDIT_CARD": mask_card,
    "BANK_ACCOUNT": lambda v: mask_partial(v, 4, "X"),
    "IP_ADDRESS": mask_ip,
    "DATE_OF_BIRTH": mask_birth_date,
    "IBAN": mask_iban,
}


def mask_value(category: Column, value: Column) -> Column:
    """The value as it may be shown."""
    expr = F.when(value.isNull() | (value == "") | value.isin(*HIDDEN), REDACTED)
    for name, rule in MASKS.items():
        expr = expr.when(category == name, rule(value))
    return expr.otherwise(mask_generic(value))
