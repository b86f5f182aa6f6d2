"""Blank tests, stripping and ordered text rules."""

from pyspark.sql import Column, functions as F

# What Python's strip takes off: every character that counts as space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Nothing but spaces; the pattern gives up at the first other character."""
    return text.rlike(f"^[{SPACES}]*$")


def first_match(text: Column, rules, otherwise: Column) -> Column:
    """Label of the first rule whose fragment occurs in ``text``; null text goes to ``otherwise``."""
    chain = F
    for fragment, label in rules:
        chain = chain.when(text.contains(fragment), label)
    return chain.otherwise(otherwise)


def translate_exact(text: Column, pairs, otherwise=None) -> Column:
    """Dictionary lookup; an unknown text gives ``otherwise``."""
    chain = F
    for known, label in pairs:
        chain = chain.when(text == known, F.lit(label))
    return chain if otherwise is None else chain.otherwise(F.lit(otherwise))
