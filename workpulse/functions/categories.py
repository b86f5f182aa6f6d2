"""Labels of cases and payments."""

import re

from pyspark.sql import Column, functions as F

from workpulse import labels as L
from workpulse.functions.text import first_match, is_blank, strip, translate_exact


def severity(text: Column) -> Column:
    """Severity class; a text without a class comes back lowercased."""
    lowered = F.lower(text)
    missing = is_blank(lowered) | lowered.contains(L.SEVERITY_OTHER)
    return first_match(lowered, L.SEVERITY_RULES, F.when(missing, L.SEVERITY_MISSING).otherwise(lowered))


def measure(text: Column) -> Column:
    return first_match(text, L.MEASURE_RULES, F.when(is_blank(text), L.MEASURE_MISSING).otherwise(text))


def unit(text: Column) -> Column:
    return first_match(text, L.UNIT_RULES, F.when(is_blank(text), L.UNIT_MISSING).otherwise(text))


def irregularity(code: Column) -> Column:
    """Irregularity label; blank is undefined, a field not given stays null, an unknown code passes."""
    return first_match(code, L.IRREGULARITY_RULES, F.when(is_blank(code), L.UNDEFINED).otherwise(code))


def status(text: Column) -> Column:
    return translate_exact(F.lower(text), L.STATUS)


def source_sla(text: Column) -> Column:
    return translate_exact(F.lower(text), L.SOURCE_SLA)


def sla_status(severity: Column, irregularity: Column, days: Column) -> Column:
    """On time when the days taken are within those allowed; no allowance or no days is late."""
    undefined = irregularity.eqNullSafe(L.UNDEFINED)
    allowed = F.when(severity == L.GRAVE, L.SLA_DAYS_GRAVE).when(
        severity.isin(L.LIGHT, L.MODERATE),
        F.when(undefined, L.SLA_DAYS_UNDEFINED).otherwise(L.SLA_DAYS_NAMED),
    )
    return F.when(days <= allowed, L.ON_TIME).otherwise(L.LATE)


def department(text: Column, company: str | None = None) -> Column:
    """Department of a payment request; anything unknown, blank too, is not informed.

    ``company`` is the organisation's name as written in three of the texts. Left out, any name fits.
    """
    chain = F
    for fragment, label in L.DEPARTMENT_RULES:
        if company is None and "{company}" in fragment:
            before, after = fragment.split("{company}")
            found = text.rlike(f"{re.escape(before)}.+{re.escape(after)}")
        else:
            found = text.contains(fragment.replace("{company}", company or ""))
        chain = chain.when(found, label)
    return chain.when(text.isNotNull(), L.DEPARTMENT_MISSING)


def frequency_multiplier(text: Column) -> Column:
    """Times per month of a frequency text; only text that is not known as it stands is stripped."""
    known = translate_exact(F.lower(text), L.FREQUENCIES)
    stripped = translate_exact(F.lower(strip(text)), L.FREQUENCIES, L.FREQUENCY_OTHER)
    return F.coalesce(known, stripped)
