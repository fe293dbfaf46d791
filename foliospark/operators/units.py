"""Units as papers print them, reduced to a canonical spelling; quantities, their dimensions, and bounds that lost their sign."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantities without a unit and the tag of each.
DIMENSIONLESS = {"dimensionless": "1", "unitless": "1", "none": "1", "count": "1", "fold": "fold", "foldchange": "fold", "foldincrease": "fold", "x": "fold", "ratio": "ratio", "ph": "pH", "phunit": "pH", "phunits": "pH", "%": "%", "percent": "%"}
TAGS = tuple(sorted(set(DIMENSIONLESS.values())))
#: Symbols, whose case matters, and names, whose case doesn't: canonical unit and factor.
SYMBOLS = {
    "s": ("s", 1.0), "h": ("s", 3600.0), "ms": ("s", 1e-3), "ns": ("s", 1e-9),
    "M": ("M", 1.0), "mM": ("M", 1e-3), "uM": ("M", 1e-6), "µM": ("M", 1e-6), "μM": ("M", 1e-6), "nM": ("M", 1e-9), "pM": ("M", 1e-12), "fM": ("M", 1e-15),
    "Å": ("Å", 1.0), "nm": ("Å", 10.0), "pm": ("Å", 0.01),
    "L": ("L", 1.0), "l": ("L", 1.0), "mL": ("L", 1e-3), "ml": ("L", 1e-3), "uL": ("L", 1e-6), "µL": ("L", 1e-6), "μL": ("L", 1e-6),
}
NAMES = {
    "sec": ("s", 1.0), "secs": ("s", 1.0), "second": ("s", 1.0), "seconds": ("s", 1.0), "min": ("s", 60.0), "mins": ("s", 60.0), "minute": ("s", 60.0), "minutes": ("s", 60.0), "hr": ("s", 3600.0), "hour": ("s", 3600.0), "hours": ("s", 3600.0),
    "molar": ("M", 1.0), "mol/l": ("M", 1.0), "moll": ("M", 1.0),
    "kcal/mol": ("kcal/mol", 1.0), "kcalmol": ("kcal/mol", 1.0), "kcal mol": ("kcal/mol", 1.0), "kj/mol": ("kcal/mol", 0.239006), "kjmol": ("kcal/mol", 0.239006),
    "g/mol": ("g/mol", 1.0), "gmol": ("g/mol", 1.0), "da": ("g/mol", 1.0), "dalton": ("g/mol", 1.0), "kda": ("g/mol", 1000.0),
    "angstrom": ("Å", 1.0), "litre": ("L", 1.0), "liter": ("L", 1.0),
}
#: Temperatures and their shift to °C; the one symbol whose lost case leaves no doubt.
DEGREES = {"C": 0.0, "°C": 0.0, "°K": -273.15, "K": -273.15}
DEGREE_NAMES = {"degc": 0.0, "celsius": 0.0, "centigrade": 0.0, "degk": -273.15, "kelvin": -273.15}
DAMAGED = {"m": "M"}
#: Units whose slash is part of their name; superscript digits.
COMPOUNDS = ("kcal/mol", "kJ/mol", "g/mol", "mol/L")
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LETTER = "[A-Za-zÅåµμ]"


def plain(text: str) -> str:
    """A unit with its exponents as ^n, however a text layer has printed them, and single blanks."""
    digits = lambda m: m.translate(str.maketrans(SUPERSCRIPTS, "0123456789"))
    x = re.sub(rf"⁻\s*([{SUPERSCRIPTS}]+)", lambda m: "^-" + digits(m[1]), text)
    x = re.sub(rf"([{SUPERSCRIPTS}]+)", lambda m: "^" + digits(m[1]), x)
    x = re.sub(r"[−‐-―]", "-", re.sub(r"[·∙*×✕⋅]", " ", x))
    x = re.sub(rf"({LETTER}) {{2,}}(\d)\b", r"\1^-\2", x)
    x = re.sub(r"\s+", " ", x)
    x = re.sub(r"\b(kcal|kj)\s*(?:/\s*mol|mol\s*\^-1)", r"\1/mol", x, flags=re.I)
    x = re.sub(rf"({LETTER})\s*\^?\s*-\s*(\d)\b", r"\1^-\2", x)
    x = re.sub(rf"({LETTER})\s+2\s+(\d)\b", r"\1^-\2", x)
    x = re.sub(rf"(\^-?\d+)(?={LETTER})", r"\1 ", x)
    return re.sub(r"\s+", " ", x).strip()


def terms(text: str) -> list[tuple[str, int]]:
    """(unit, exponent) of each term; a slash turns the sign of what follows. None if any part isn't a term."""
    for c in COMPOUNDS:
        text = re.sub(c.replace("/", r"\s*/\s*"), c.replace("/", "\x01"), text, flags=re.I)
    out: list[tuple[str, int]] = []
    sign = 1
    for chunk in text.split("/"):
        if chunk.strip() in ("", "1"):
            sign = -1 if sign == 1 and not out else -sign
            continue
        for token in chunk.split():
            m = re.fullmatch(r"([A-Za-zÅåµμ°%][A-Za-z/µμ°%]*)(?:\^?\s*(-?\d+))?", token.replace("\x01", "/"))
            if not m or m[2] is not None and int(m[2]) == 0:
                return []
            out.append((m[1], sign * int(m[2] or 1)))
        sign = -1
    return out


def canonical_unit(text: str | None) -> tuple[str, float, float] | None:
    """(canonical unit, scale, shift), or None for a spelling that isn't known for certain: an unknown unit never becomes a
    known one, and a symbol whose case is damaged is not guessed at."""
    raw = (text or "").strip()
    tag = DIMENSIONLESS.get(re.sub(r"[\s.]", "", raw.lower()))
    if not raw or tag:
        return (tag, 1.0, 0.0) if tag else None
    norm = plain(raw)
    shift = DEGREES.get(norm, DEGREE_NAMES.get(re.sub(r"[\s°.]", "", norm.lower())))
    if shift is not None:
        return "°C", 1.0, shift
    powers: dict[str, int] = {}
    scale = 1.0
    for unit, power in terms(norm):
        base = SYMBOLS.get(unit) or NAMES.get(unit.lower()) or SYMBOLS.get(DAMAGED.get(unit, ""))
        if base is None:
            return None
        scale *= base[1] ** power
        powers[base[0]] = powers.get(base[0], 0) + power
    if not powers:
        return None
    return " ".join(u if p == 1 else f"{u}^{p}" for u, p in sorted(powers.items()) if p) or "1", scale, 0.0


def table_of(units: DataFrame, unit: str) -> DataFrame:
    """(unit, canonical_unit, scale, shift) of each distinct unit that is known. Only distinct spellings are parsed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(u, *c) for u in pdf[unit] if (c := canonical_unit(u))]
            yield pd.DataFrame(found, columns=[unit, "canonical_unit", "scale", "shift"])

    return units.select(unit).where(F.col(unit).isNotNull()).distinct().mapInPandas(run, f"`{unit}` string, canonical_unit string, scale double, shift double")


def canonical(records: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Adds canonical_unit and canonical_value, scale and shift; absent where the unit isn't known."""
    return records.join(table_of(records, unit), unit, "left").withColumn("canonical_value", F.col(value) * F.col("scale") + F.col("shift"))


def compatible(declared: Column, measured: Column) -> Column:
    """Of two canonical units: true if equal, null if either is unknown or both are tags without a unit, else false."""
    tags = declared.isin(*TAGS) & measured.isin(*TAGS)
    return F.when(declared == measured, True).when(declared.isNotNull() & measured.isNotNull() & ~tags, False)


BOUND = re.compile(r"([Nb])\s*[~≈]?\s*(\d[\d.,]*)\s*([^\s\d]*[^\d]*)")


def bound_of(text: str | None) -> tuple[str, float] | None:
    """(> or <, figure) of a text whose sign came out as N or b, and which holds a figure and a known unit besides."""
    m = BOUND.fullmatch((text or "").strip())
    if not m or m[3].strip() and not canonical_unit(m[3]):
        return None
    try:
        return ">" if m[1] == "N" else "<", float(m[2].replace(",", ""))
    except ValueError:
        return None


def bounds(records: DataFrame, text: str) -> DataFrame:
    """(text, sign, figure) of each distinct text that is a damaged bound."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(t, *b) for t in pdf[text] if (b := bound_of(t))]
            yield pd.DataFrame(found, columns=[text, "sign", "figure"])

    return records.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, sign string, figure double")
