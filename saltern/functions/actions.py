"""Scalars of corporate-action texts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts of dates, tried in this order.
DATE_LAYOUTS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "yyyyMMdd")


def clean(x: str | Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def security_key(isin: str, symbol: str, series: str) -> Column:
    return F.when(clean(F.col(isin)).isNotNull(), F.concat(F.lit("ISIN:"), clean(F.col(isin)))).otherwise(F.concat_ws(":", F.lit("NSE"), clean(F.col(symbol)), clean(F.col(series))))


def valid_isin(x: Column) -> Column:
    up = F.regexp_replace(F.upper(x), r"\s", "")
    return F.when(up.rlike("^[A-Z]{2}[A-Z0-9]{10}$"), up)


#: Words of a purpose and the kind they name, the first that occurs deciding; and whole texts that do.
KINDS = (
    ("bonus", ("bonus",)),
    ("split_or_consolidation", ("split", "sub-division", "subdivision", "consolidation")),
    ("rights", ("right",)),
    ("demerger", ("demerger",)),
    ("merger_or_scheme", ("merger", "amalgamation", "scheme of arrangement")),
    ("dividend", ("dividend",)),
    ("buyback", ("buyback", "buy back")),
    ("interest", ("interest",)),
    ("general_meeting", ("annual general meeting", "extra ordinary general meeting", "extraordinary general meeting")),
)
MEETINGS = ("agm", "egm")


def action_kind(text: str) -> Column:
    """The kind of an action's purpose; a null or unknown purpose is ``other``."""
    low = F.lower(F.col(text))
    out = F.when(F.trim(low).isin(*MEETINGS), "general_meeting")
    for kind, words in KINDS:
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), kind)
    return out.otherwise("other")


def share_multiplier(text: str) -> Column:
    """New shares for an old one: a bonus of a:b gives (a + b) / b; a split from face x to y gives x / y."""
    a, b = (F.expr(f"try_cast(nullif(regexp_extract(lower({text}), '([0-9]+) ?: ?([0-9]+)', {k}), '') as double)") for k in (1, 2))
    x, y = (F.expr(f"try_cast(nullif(regexp_extract(lower({text}), 'from (?:rs|re)?[ .]*([0-9.]+).*? to (?:rs|re)?[ .]*([0-9.]+)', {k}), '') as double)") for k in (1, 2))
    kind = action_kind(text)
    return F.when((kind == "bonus") & (b > 0), (a + b) / b).when((kind == "split_or_consolidation") & (y > 0), x / y)


def dividend_total(text: str) -> Column:
    """Sum of all amounts in the text."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"r[se]\.? ?([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_date(x: str) -> Column:
    return F.coalesce(*[F.try_to_date(F.col(x), f) for f in DATE_LAYOUTS])


def lineage_id(*parts: str) -> Column:
    """A stable name for a lineage without an ISIN: sixteen digits of the SHA-1 of its parts."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("NSELINEAGE:"), F.substring(F.sha1(joined), 1, 16))
