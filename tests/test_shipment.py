from __future__ import annotations

import pytest

from customsloom.operators import shipment

FIELDS = ["gross", "net", "tare", "packages", "type", "pallets", "dims"]
CASES = {
    "Gross weight: 1.250,5 kg Net weight 1,200.25": {"gross": 1250.5, "net": 1.20025},  # as the rule of numbers has it: not decimal, so the point separates
    "bruto teža:\n12,5 kg": {"gross": 12.5},
    "Neto 11 kg Bruto 12 kg": {"net": 11.0, "gross": 12.0},
    "Gross    Net    Tare\n 12.5    11.0    1.5": {"gross": 12.5, "net": 11.0, "tare": 1.5},
    "Net    Gross\n 11 kg  12 kg": {"net": 11.0, "gross": 12.0},
    "62\n\nTara": {}, "Tara\n\n62": {}, "2 t bruto": {}, "62\nTara\n2 t bruto": {"tare": 2000.0},  # values before a weight's label, or under a line that isn't next
    "35 CARTONS (1 PALLETE)": {"packages": 35, "type": "CT", "pallets": 1},
    "Packing: 3 colli, 2 x pallets": {"packages": 3, "type": "COLLI", "pallets": 2},
    "2 pallets": {"type": "PALLET", "pallets": 2},
    "number of packages 7, gross 7 lb": {"packages": 7, "type": "COLLI", "gross": 3.175147},
    "dimensions 1200x800x1450 mm, 4 box": {"dims": "120x80x145 cm", "packages": 4, "type": "CT"},
    "packages 2.5 kg gross 3": {"gross": 3.0},
    "gross net 5 kg": {"net": 5.0},  # one value: the nearer label has it
    "Gross weight kg 17,5": {"gross": 17.5},
    "netbook 5 kg, grossly 7": {},
    "": {}, None: {},
}


@pytest.mark.parametrize("text", list(CASES))
def test_facts(text):
    got = {f: v for f, v in zip(FIELDS, shipment._facts(text), strict=True) if v is not None}
    assert got == CASES[text]


def test_numbers():
    assert [shipment.number(x) for x in ("12", "12.5", "12,5", "1.234", "1.234,56", "1.234.567", "12,3456")] == [12.0, 12.5, 12.5, 1.234, 1234.56, 1234567.0, 12.3456]


def test_every_value_counts_once_and_long_texts_take_their_length():
    text = "\n".join(f"gross {i} kg net {i} kg" for i in range(1, 4000))
    found = shipment.assigned(text)
    assert len(found) == 2 * 3999 and found[-1] == ("net", "net", 3999.0)
    assert shipment.assigned("gross " * 500 + "5 kg") == [("gross", "gross", 5.0)]


def test_rows(spark):
    df = spark.createDataFrame([(1, "gross 5 kg"), (1, "gross 6 kg"), (None, "2 pallets"), (2, None)], "id int, text string")
    assert sorted(((r["id"], r["gross_kg"], r["pallets"]) for r in shipment.summaries(df).collect()), key=str) == [(1, 5.0, None), (1, 6.0, None), (2, None, None), (None, None, 2)]
    assert shipment.summaries(df.limit(0)).count() == 0
