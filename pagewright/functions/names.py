"""Names of files and pages, and text normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as scripts of the web count it: ASCII, no-break, and the Unicode spaces.
SPACES = r"[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MAX_STEM = 120


def file_stem(name: Column) -> Column:
    """A name without its ending and without what file systems refuse; null if nothing is left."""
    s = F.regexp_replace(name, r"\.[^.]*$", "")
    s = F.regexp_replace(s, r'[\x00-\x1F\x7F<>:"/\\|?*]+', "_")
    s = F.regexp_replace(s, SPACES + "+", " ")
    s = F.regexp_replace(s, r"^[. ]+|[. ]+$", "")
    return F.nullif(F.regexp_replace(F.substring(s, 1, MAX_STEM), r"[. ]+$", ""), F.lit(""))


def download_name(stem: Column, suffix: str, fallback: str, *parts: Column) -> Column:
    """Stem and suffix, or the fallback alone, and the parts that are not empty."""
    head = F.when(stem.isNull() | (stem == ""), F.lit(fallback)).otherwise(F.concat_ws("_", stem, F.lit(suffix)))
    return F.concat_ws("_", head, *[F.nullif(p, F.lit("")) for p in parts])


def sortable_name(n: Column, total: Column, prefix: str, ending: str) -> Column:
    """``prefix-007.ending``: as many digits as the total has, three at least; null outside 1..total."""
    width = F.greatest(F.lit(3), F.length(total.cast("string")))
    return F.when((n >= 1) & (total >= n), F.concat(F.lit(prefix + "-"), F.lpad(n.cast("string"), width, F.lit("0")), F.lit("." + ending)))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_ascii(text: Column) -> Column:
    """``normalize_text`` of what is ASCII: spaces squeezed and trimmed, in the JVM alone."""
    return F.trim(F.regexp_replace(text, SPACES + "+", " "))


def normalize_text(text: Column) -> Column:
    """Compatibility form, spaces squeezed and trimmed. ASCII texts never leave the JVM's text."""
    form = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)
    return normalize_ascii(form)


#: Keywords of font names, the first family that matches counts.
FONT_RULES = {
    "bold": "bold|black|heavy|demi",
    "italic": "italic|oblique",
    "family": [("mono", "courier|mono|consol|typewriter"), ("serif", "times|serif|georgia|garamond|roman"), ("sans", "")],
}


def font_class(name: Column, rules: dict = FONT_RULES) -> Column:
    """bold, italic and family of a font name, without the tag of a subset (six capitals and a plus)."""
    low = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    families = rules["family"]
    family = F.lit(families[-1][0])
    for label, pattern in reversed(families[:-1]):
        family = F.when(low.rlike(pattern), F.lit(label)).otherwise(family)
    return F.struct(low.rlike(rules["bold"]).alias("bold"), low.rlike(rules["italic"]).alias("italic"), family.alias("family"))
