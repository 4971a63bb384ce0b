"""Text normalisers, predicates and tokenisers of the panel, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results must agree with.
NOISE = r"\b(m/v/x|m/f/d|m/v|fulltime|full[- ]time|parttime|part[- ]time|freelance|zzp|interim|vacature|vacancy|hybrid|remote|onsite|per direct|urgent|new|nieuw)\b"
LEGAL_FORMS = r"\b(b\.?v\.?|n\.?v\.?|inc|ltd|gmbh|group|nederland)\b"
TITLE_NOISE = r"\b(m/v/x|m/f/d|m/v|fulltime|parttime|freelance|zzp|vacature)\b"
PLACEHOLDER = r"(?i)lorem ipsum|dolor sit amet|consectetur adipiscing"
AI_TERMS = (
    r"(?i)\b(ai|a\.i\.|artificial intelligence|kunstmatige intelligentie|machine learning|deep learning|ml|mlops|llm|genai|generative ai|data scien|data engineer|"
    r"data analy|datascien|nlp|natural language|computer vision|neural|algoritme|algorithm|model|analytics|statist)\b"
)
AI_CATEGORIES = ("ml-engineer", "data-scientist", "ai-engineer", "ai-general", "ai-researcher", "cv-engineer", "ai-product", "data-engineer", "ai-manager", "data-general", "nlp-engineer", "data-analyst")
STOP_WORDS = tuple(
    """
de het een en van in op voor met te dat die is zijn we wij je jij jouw ons onze
u uw als aan bij naar door over uit om ook maar of dan er heeft hebben wordt
worden kan kunnen zal zullen niet geen meer veel zeer goed nieuw werk werken
functie bedrijf team collega collega's ervaring kennis binnen waar deze dit
the a an and or of to in for with on at as is are be been we you your our us
their this that will can may have has had from by about into more most very
you'll we're role job position company team work working experience years
knowledge skills strong good great new opportunity looking join apply
candidate candidates ideal must should would could well including etc
""".split()
)
TERM = r"\b[a-zA-Z][a-zA-Z+#./-]{1,}\b"

_ascii = re.compile(r"[\x00-\x7f]*").fullmatch


@F.pandas_udf(StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such function."""

    def one(x: str | None) -> str | None:
        if x is None or _ascii(x):
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(one)


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end; null as ''."""
    return F.regexp_replace(blank_if_null(c), r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]+", " "), r"\s+", " "))


def normalise_title(title: Column, decompose: bool = True) -> Column:
    """The comparable core of a title. `decompose=False` is for input without marks: it stays within the JVM."""
    s = blank_if_null(title)
    s = F.lower(unmarked(s) if decompose else s)
    s = F.regexp_replace(s, r"[\(\[\{].*?[\)\]\}]", " ")
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    return squeezed(F.regexp_replace(s, f"(?i){NOISE}", " "))


def normalise_company(company: Column, decompose: bool = True) -> Column:
    s = blank_if_null(company)
    s = F.lower(unmarked(s) if decompose else s)
    return squeezed(F.regexp_replace(s, LEGAL_FORMS, " "))


def clean_title(title: Column) -> Column:
    """Of titles as names of groups: keeps + # / and -."""
    s = F.regexp_replace(F.lower(blank_if_null(title)), r"[\(\[].*?[\)\]]", " ")
    s = F.regexp_replace(F.regexp_replace(s, TITLE_NOISE, " "), r"[^a-z0-9+#/ -]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ \-/]+|[ \-/]+$", "")


def is_placeholder(description: Column) -> Column:
    return F.coalesce(description.rlike(PLACEHOLDER), F.lit(False))


def skills_of(skills: Column) -> Column:
    """The set of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(blank_if_null(skills), ","), F.trim), lambda x: x != ""))


def is_relevant(category: Column, title: Column, skills: Column) -> Column:
    """By category, by a term of the title, or by any skill (an array)."""
    return F.lower(F.trim(blank_if_null(category))).isin(*AI_CATEGORIES) | blank_if_null(title).rlike(AI_TERMS) | (F.size(skills) > 0)


def advert_text(title: Column, company: Column, description: Column, most: int = 2000) -> Column:
    """Title twice, company, start of the description, joined by ' . ' and without empty parts."""
    t, d = F.nullif(trimmed(title), F.lit("")), F.nullif(trimmed(description), F.lit(""))
    return F.concat_ws(" . ", t, t, F.nullif(blank_if_null(company), F.lit("")), F.substring(d, 1, most))
