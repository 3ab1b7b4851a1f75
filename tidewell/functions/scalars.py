"""Column functions of the panel operators: rates, names, codes, transforms."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Position codes, status priorities, reasons that are not physical, position depth of a ranking.
POSITIONS = {"QB": "QB", "RB": "RB", "FB": "RB", "HB": "RB", "WR": "WR", "TE": "TE", "K": "K", "PK": "K"}
STATUS_PRIORITY = {"ACT": 0, "RES": 1, "DEV": 2, "E14": 3, "SUS": 4, "NWT": 5, "CUT": 6, "RET": 7}
NON_PHYSICAL = (
    "illness|covid.*|not\\s+injury\\s+related.*|non[- ]injury.*|personal|rest(?:ed|ing)?(?:\\s+(?:player|veteran|vet))?"
    "|coach(?:'s)?\\s+decision|coaching\\s+decision"
)
#: Coefficients of the fit, relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
TOP_K = {"QB": 12, "RB": 24, "WR": 36, "TE": 12, "K": 12}


def mapped(value: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table, else `default` (null)."""
    out = F.lit(None) if default is None else default
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)).otherwise(out)
    return out


def numeric(value: Column) -> Column:
    """A number from text or number; what is none, NaN or infinite is null."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def rate(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not above 0 or either is unknown."""
    return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _ascii(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is then not ASCII; Spark has no such function."""
    return names.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normal_name(name: Column) -> Column:
    """Lower-case letter and digit tokens joined, without generation suffixes; accents and other letters dropped."""
    tokens = F.regexp_extract_all(F.lower(F.pandas_udf(_ascii, "string")(name)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin("jr", "sr", "ii", "iii", "iv")), "")


def flipped_name(name: Column) -> Column:
    """`Last, First` as `First Last`."""
    parts = F.split(name, ",", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(F.trim(name))


def slug(*parts: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("|", *parts)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pseudo_id(known: Column, season: Column, *parts: Column) -> Column:
    """`pfr:` and a known id, else `prospect:`, the season and a slug of the parts (`unknown` if none is left)."""
    named = F.coalesce(F.nullif(slug(*parts), F.lit("")), F.lit("unknown"))
    return F.when(known.isNotNull() & (known != ""), F.concat(F.lit("pfr:"), known)).otherwise(F.concat(F.lit("prospect:"), season.cast("string"), F.lit(":"), named))


def height_inches(text: Column) -> Column:
    """`6-2` as 74; anything else is null."""
    feet, inches = (F.regexp_extract(text, r"^(\d+)-(\d+)$", i) for i in (1, 2))
    return F.when(feet != "", feet.try_cast("int") * 12 + inches.try_cast("int"))


def physical(reason: Column, non_physical: str = NON_PHYSICAL) -> Column:
    """Whether a reason is given and is not one of the non-physical ones."""
    clean = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    return (clean != "") & ~clean.rlike(f"(?i)^(?:{non_physical})$")


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z >= 0, by a Chebyshev fit of the complementary error function."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(poly - x * x) / 2


def risk_band(p: Column) -> Column:
    """Right-closed bands of a probability."""
    return F.when((p > -0.001) & (p <= 0.2), "lower").when((p > 0.2) & (p <= 0.35), "moderate").when((p > 0.35) & (p <= 1.001), "higher")


def combined_score(pct: Column, health: Column, weight: float) -> Column:
    """100 * ((1 - w) * pct + w * health) for w in [0, 1]."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in [0, 1]")
    return 100 * ((1 - weight) * pct + weight * health)


def age_at(season: Column, birth: Column) -> Column:
    """Years from birth to the first of September of a season."""
    return F.datediff(F.make_date(season, F.lit(9), F.lit(1)), birth) / 365.2425


def family(name: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The family of the first pattern that a column's name matches."""
    out = F.lit(default)
    for pattern, kind in reversed(rules):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out
