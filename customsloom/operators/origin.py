"""Preferential origin: schemes by destination, document decisions and the precedence of line rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from customsloom.functions.country import in_eu
from customsloom.functions.text import positions

#: Countries of the schemes.  Fixed values.
UK = ["GB"]
REX = ["CA", "JP", "KR", "SG", "VN"]
PEM = ["CH", "NO", "IS", "LI", "TR", "RS", "ME", "MK", "AL", "BA", "XK", "MD", "GE", "UA", "EG", "IL", "JO", "LB", "MA", "TN", "DZ", "FO", "PS"]
#: Value in euros up to which any exporter may declare origin on an invoice.
DECLARATION_LIMIT = 6000.0
_AUTHORISATION, _NUMBER, _SLASHED, _COMPACT = r"customs\s+authori[sz]ation", r"(?:no\.?|number)", r"[A-Z]{2}\/\d+\/\d+", r"[A-Z]{2}\d{6}\/\d{4}"
_EXPORTER = r"authori[sz]ed\s+exporter"
#: Kinds of declarations, by patterns; group 1 of positions_yes and eur1_except has positions, ranges too.  Fixed values.
DECLARATIONS = {
    "positions_yes": [
        r"positions?\s+([\d,\s\-–and]+)\s+(?:are\s+)?(?:of\s+)?(?:(?:EU|E\.U\.)\s+)?preferential\s+origin",
        r"position\s+([\d,\s\-–and]+)\s+(?:is|are)\s+(?:of\s+)?(?:(?:EU|E\.U\.)\s+)?preferential\s+origin",
    ],
    "all_yes": [
        r"products?\s+covered\s+by\s+this\s+document\s+are\s+of\s+preferential\s+origin",
        r"these\s+products\s+are\s+of\s+(?:EU\s+)?preferential\s+origin",
        r"exporter\s+of\s+the\s+products\s+covered\s+by\s+this\s+document[\s\S]{0,800}?preferential\s+origin",
        r"declare(?:s|d)?\s+that\s+the\s+products?\s+(?:on\s+this\s+invoice\s+)?(?:are|is)\s+of\s+(?:(?:EU|E\.U\.)\s+)?preferential\s+origin",
        r"all\s+(?:the\s+)?(?:products?|goods?|items?|lines?)\s+(?:on\s+this\s+(?:invoice|document))?\s+(?:are|is)\s+of\s+(?:(?:EU|E\.U\.)\s+)?preferential\s+origin",
        r"preferential\s+origin\s+(?:declaration\s+)?(?:applies\s+to\s+)?all\s+(?:products?|goods?|positions?|lines?)",
    ],
    "eur1_except": [
        r"eur\.?\s*1\s+(?:enclosed|attached|included|provided|issued).*?except(?:\s+where\s+otherwise\s+indicated)?(?:\s+(?:for\s+)?)?(?:positions?\s+)?([\d,\s\-–and]+)",
        r"preferential\s+origin\s+(?:declaration\s+)?applies\s+to\s+all\s+(?:positions|products|lines|goods)\s+except\s+(?:positions?\s+)?([\d,\s\-–and]+)",
        r"(?:applies\s+to\s+all|all)\s+(?:positions|products|lines|goods)\s+except\s+(?:positions?\s+)?([\d,\s\-–and]+)",
    ],
    "otherwise": [r"except\s+where\s+otherwise\s+clearly\s+indicated", r"except\s+where\s+otherwise\s+indicated"],
    "asterisk": [r"articles?,?\s+which\s+are\s+not\s+marked\s+with\s+sign\s*\(\s*\*\s*\)"],
    "supplier": [r"(?:short-term|long-term)\s+supplier\s+declaration|STSD|LTSD|supplier\s+declaration"],
    "manufacturer": [r"manufacturer(?:'?s)?\s+declaration"],
    "authorised": [
        rf"exporter\s+of\s+(?:the\s+)?products\s+covered\s+by\s+this\s+document[\s\S]{{0,300}}?\(\s*{_AUTHORISATION}\s+{_NUMBER}\s*{_SLASHED}\s*\)",
        rf"{_AUTHORISATION}\s+{_NUMBER}\s*{_SLASHED}",
        rf"{_AUTHORISATION}\s+{_NUMBER}\s+{_COMPACT}",
        rf"{_EXPORTER}\s+{_NUMBER}\s*{_SLASHED}",
        rf"{_EXPORTER}\s+{_NUMBER}\s+{_COMPACT}",
        r"authorised\s+exporter|authorized\s+exporter|\bREX[\s-]?(?:No|Number|#)?",
    ],
}
#: An origin declaration at large; words by which an EUR.1 covers what it doesn't except.  Fixed values.
DECLARED = [
    r"the\s+exporter\s+of\s+the\s+products\s+covered\s+by\s+this\s+document[\s\S]{0,900}?preferential\s+origin\.?", r"these\s+products\s+are\s+of\s+(?:EU\s+)?preferential\s+origin\.?",
    r"products?\s+covered\s+by\s+this\s+document[\s\S]{0,400}?preferential\s+origin", rf"{_AUTHORISATION}\s+{_NUMBER}\s*{_SLASHED}[\s\S]{{0,400}}?preferential\s+origin",
]
COVERS_REST = [
    r"all\s+(?:other|remaining)\s+(?:positions|line\s+items|products|goods)", r"all\s+(?:positions|products|line\s+items|goods|lines)\s+except", r"for\s+all\s+(?:positions|products|line\s+items|goods|lines)\s+except",
    r"covers\s+all\s+(?:positions|products|items|lines|goods)\s+except", r"applies\s+to\s+all\s+(?:positions|products|items|lines|goods)\s+except",
    r"eur\.?\s*1\s+(?:enclosed|attached|included|provided|issued)\s+for\s+all\s+(?:positions|products|line\s+items|goods)\s+except",
]


def scheme(country: Column) -> Column:
    """UK, REX, PEM or NO_PREFERENCE for a destination."""
    return F.when(country.isNull() | in_eu(country), "NO_PREFERENCE").when(country.isin(UK), "UK").when(country.isin(REX), "REX").when(country.isin(PEM), "PEM").otherwise("NO_PREFERENCE")


def decision(scheme_of: Column, declared: Column, authorised: Column, statement: Column, value: Column) -> tuple[Column, Column]:
    """(evidence status, case 0 to 4) of a document."""
    small = value <= DECLARATION_LIMIT
    by_statement = scheme_of.isin("UK", "REX")
    case = (
        F.when(scheme_of == "NO_PREFERENCE", 0)
        .when(by_statement & statement, 1)
        .when(by_statement, 2)
        .when(declared & authorised, 4)
        .when(declared & small, 1)
        .when(declared, 3)
        .when(small, 2)
        .otherwise(3)
    )
    status = F.when(scheme_of == "NO_PREFERENCE", "NOT_DECLARED").when((by_statement & statement) | (~by_statement & declared & (authorised | small)), "DECLARED").when(~by_statement & declared, "UNVERIFIED").otherwise("NOT_DECLARED")
    return status, case


def _any(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def found(text: Column) -> dict[str, Column]:
    """Whether each kind of declaration stands in a text."""
    return {k: _any(text, p) for k, p in DECLARATIONS.items()}


def named_positions(text: Column, kind: str, mode: str = "ranges") -> Column:
    """Positions that the declarations of a kind name, sorted.  A dash makes a range; with mode ``reference`` a list ends before one."""
    if mode not in ("ranges", "reference"):
        raise ValueError(mode)
    patterns = DECLARATIONS[kind] if mode == "ranges" else [p.replace(r"\-–", "") for p in DECLARATIONS[kind]]
    parts = [F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in patterns]
    return F.coalesce(positions(F.array_join(F.concat(*parts), " , ")), F.array().cast("array<int>"))


def authorisation_number(text: Column) -> Column:
    """The number of a customs authorisation or an authorised exporter, null without one."""
    number = F.regexp_extract(text, rf"(?i)(?:{_AUTHORISATION}|{_EXPORTER})\s+{_NUMBER}\s*({_SLASHED}|{_COMPACT})", 1)
    return F.when(number != "", F.upper(number))


def line_preference(position: Column, text: Column, country: Column | None = None, description: Column | None = None, mode: str = "ranges") -> Column:
    """YES, NO, UNKNOWN or NOT_DECLARED of a line by its document's declarations.

    In this order: marks by asterisk, exclusion, naming, a declaration for all (one at large too, if nothing is excluded or left open), the rest of an exception (if it says so), an authorised exporter's declaration,
    "except where otherwise indicated", references to suppliers' and manufacturers' declarations; without any a line of a known country isn't declared and others are unknown.
    ``mode`` as for ``named_positions``.
    """
    has, excluded, named = found(text), named_positions(text, "eur1_except", mode), named_positions(text, "positions_yes", mode)
    declared = _any(text, DECLARED)
    none_named, none_excluded = F.size(named) == 0, F.size(excluded) == 0
    all_yes = none_named & (has["all_yes"] | (declared & none_excluded & ~has["otherwise"]))
    marked = F.lit(False) if description is None else F.coalesce(description.contains("*"), F.lit(False))
    known = F.lit(True) if country is None else F.coalesce(~F.trim(country).isin("", "—"), F.lit(False))
    return (
        F.when(has["asterisk"], F.when(marked, "YES").otherwise("NO"))
        .when(F.array_contains(excluded, position), "NO")
        .when(F.array_contains(named, position), "YES")
        .when(all_yes, "YES")
        .when(~none_excluded, F.when(_any(text, COVERS_REST), "YES").otherwise("UNKNOWN"))
        .when(has["authorised"] & declared & none_named, "YES")
        .when(has["otherwise"] | has["supplier"] | has["manufacturer"], "UNKNOWN")
        .otherwise(F.when(known, "NOT_DECLARED").otherwise("UNKNOWN"))
    )


def with_exclusions(preference: Column, style: Column, excluded: list[str]) -> Column:
    """NO for styles of an exclusion list."""
    return F.when(style.isin(excluded), "NO").otherwise(preference)


def document_status(yes: Column, no: Column, undeclared: Column) -> Column:
    """MIXED, CONFIRMED, NOT_PREFERENTIAL or NOT_DECLARED from numbers of lines."""
    return F.when((yes > 0) & ((no > 0) | (undeclared > 0)), "MIXED").when(yes > 0, "CONFIRMED").when(no > 0, "NOT_PREFERENTIAL").otherwise("NOT_DECLARED")
