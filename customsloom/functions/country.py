"""Countries: codes, names in addresses, the European Union, routes, duty and VAT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from customsloom.functions.tariff import of_map

#: ISO 3166 codes of the Union's members, their English names and standard VAT rates in percent.  Fixed values.
EU = {
    "AT": ("austria", 20.0), "BE": ("belgium", 21.0), "BG": ("bulgaria", 20.0), "HR": ("croatia", 25.0), "CY": ("cyprus", 19.0), "CZ": ("czechia", 21.0), "DK": ("denmark", 25.0),
    "EE": ("estonia", 24.0), "FI": ("finland", 25.5), "FR": ("france", 20.0), "DE": ("germany", 19.0), "GR": ("greece", 24.0), "HU": ("hungary", 27.0), "IE": ("ireland", 23.0),
    "IT": ("italy", 22.0), "LV": ("latvia", 21.0), "LT": ("lithuania", 21.0), "LU": ("luxembourg", 17.0), "MT": ("malta", 18.0), "NL": ("netherlands", 21.0), "PL": ("poland", 23.0),
    "PT": ("portugal", 23.0), "RO": ("romania", 19.0), "SK": ("slovakia", 23.0), "SI": ("slovenia", 22.0), "ES": ("spain", 21.0), "SE": ("sweden", 25.0),
}
#: Other names that addresses hold.  Fixed values.
NAMES = {name: code for code, (name, _) in EU.items()} | {"united kingdom": "GB", "great britain": "GB", "switzerland": "CH", "serbia": "RS", "turkey": "TR", "norway": "NO", "ukraine": "UA", "united states": "US", "usa": "US", "china": "CN"}


def code(text: Column) -> Column:
    """Two letters, upper case; else null."""
    c = F.upper(F.trim(text))
    return F.when(c.rlike(r"^[A-Z]{2}$"), c)


def resolve(text: Column) -> Column:
    """A code, a code in brackets, or a country's name, in the last line first."""
    lines = F.reverse(F.filter(F.split(text, r"[\n,]"), lambda x: F.trim(x) != ""))

    def of(line: Column) -> Column:
        bracket = F.regexp_extract(F.upper(line), r"\(([A-Z]{2})\)", 1)
        return F.coalesce(code(line), F.when(bracket != "", bracket), of_map(F.lower(F.trim(line)), NAMES))

    return F.try_element_at(F.filter(F.transform(lines, of), lambda x: x.isNotNull()), F.lit(1))


def in_eu(country: Column) -> Column:
    return country.isin(list(EU))


def route_type(origin: Column, destination: Column) -> Column:
    """INTRA_EU, IMPORT, EXPORT or THIRD_COUNTRY."""
    a, b = in_eu(origin), in_eu(destination)
    return F.when(a & b, "INTRA_EU").when(b, "IMPORT").when(a, "EXPORT").otherwise("THIRD_COUNTRY")


def vat_rate(country: Column) -> Column:
    return of_map(country, {c: rate for c, (_, rate) in EU.items()})


def documents(mode: Column, route: Column, incoterm: Column) -> Column:
    """The papers that a shipment needs, in order, without repeats."""
    found = F.array(
        F.lit("Commercial invoice"),
        F.lit("Packing list"),
        F.when(mode == "ROAD", "CMR consignment note").when(mode == "SEA", "Bill of lading").when(mode == "AIR", "Air waybill"),
        F.when(route == "IMPORT", "Import declaration").when(route == "EXPORT", "Export declaration").when(route == "THIRD_COUNTRY", "Transit declaration"),
        F.when(route != "INTRA_EU", "Certificate of origin"),
        F.when(incoterm.isin("CIF", "CIP"), "Insurance certificate"),
    )
    return F.array_distinct(F.array_compact(found))
