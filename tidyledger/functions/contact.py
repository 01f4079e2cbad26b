"""Email and phone expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def email(value: Column) -> Column:
    """Lower-cased when there is exactly one ``@`` with text on both sides; otherwise untouched."""
    return F.when(value.rlike(r"^[^@]+@[^@]+$"), F.lower(value)).otherwise(value)


@dataclass(frozen=True)
class DialPlan:
    calling_code: str
    trunk: str
    national: str  # shape of a valid national number, trunk prefix removed


# Public numbering-plan facts. Countries outside this table stay untouched.
DIAL_PLANS = {
    "US": DialPlan("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    "CA": DialPlan("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    "GB": DialPlan(
        "44", "0", r"(1\d{8,9}|2(0[01378]|[3489]\d)\d{7}|3[0347]\d{8}|7[1-57-9]\d{8}|8\d{9}|9[018]\d{8})"
    ),
    "MX": DialPlan("52", "01", r"[1-9]\d{9}"),
    "AU": DialPlan("61", "0", r"[23478]\d{8}"),
    "DE": DialPlan("49", "0", r"[1-9]\d{5,12}"),
    "FR": DialPlan("33", "0", r"[1-9]\d{8}"),
}


def phone(value: Column, country: Column) -> Column:
    """E.164 form under the row's country; without a known country or a valid number, untouched."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    dialable = value.rlike(r"^\+?[0-9 ().\-/]+$")
    international = F.startswith(value, F.lit("+"))

    by_plus = F.lit(None).cast("string")
    seen: set[str] = set()
    for plan in DIAL_PLANS.values():
        if plan.calling_code not in seen:
            seen.add(plan.calling_code)
            whole = digits.rlike(f"^{plan.calling_code}{plan.national}$")
            by_plus = F.coalesce(F.when(whole, F.concat(F.lit("+"), digits)), by_plus)

    by_country = F.lit(None).cast("string")
    for code, plan in DIAL_PLANS.items():
        national = F.regexp_replace(digits, f"^{plan.trunk}(?={plan.national}$)", "")
        e164 = F.when(
            national.rlike(f"^{plan.national}$"), F.concat(F.lit("+" + plan.calling_code), national)
        ).when(digits.rlike(f"^{plan.calling_code}{plan.national}$"), F.concat(F.lit("+"), digits))
        by_country = F.when(country == code, e164).otherwise(by_country)

    known = F.when(international, by_plus).otherwise(by_country)
    return F.coalesce(F.when(country.isNotNull() & dialable, known), value)
