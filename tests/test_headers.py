"""Misspelt headers, and rents in two parts."""

import itertools
import random

from parcelspark.sources import delimited


def test_misspelt_headers():
    assert delimited.map_header(["Tennant", "Monthyl Rent", "Lease Expires", "Unit", "Proprety"]) == {"tenant": 0, "rent": 1, "end": 2, "unit": 3, "property": 4}
    # short words, market rents and other words stay what they are; no column is taken twice
    assert delimited.map_header(["Uint", "Marekt Rent", "Market Rnet", "Tenet", "Resident", "Residnt"]) == {"tenant": 4}
    assert delimited.map_header(["Lease Satrt", "Lease Start"]) == {"start": 1}
    assert delimited.map_header(["", "Lease Stattus"]) == {}


def test_one_slip_equals_every_edit():
    rng, letters = random.Random(3), "abcd"

    def near(w):
        yield from (w[:i] + w[i + 1 :] for i in range(len(w)))
        yield from (w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters)
        yield from (w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters)
        yield from (w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))

    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 8))) for _ in range(60)}
    for a, b in itertools.product(words, words):
        edited = b in set(near(a))
        assert (a == b or delimited.one_slip(a, b)) == (a == b or edited)
        assert not edited or delimited.cut_forms(a) & delimited.cut_forms(b)


def rents(text):
    return [r["rent"] for r in delimited.parse_file("f", text.encode())]


def test_rent_is_portion_and_subsidy():
    assert rents("Tenant,Unit,Tenant Portion,HAP\nAnn,1,$300.00,\"$1,200\"\nBob,2,,900\nCy,3,250,\nDi,4,,\n") == ["1500.00", "900.00", "250.00", None]
    assert rents("Tenant,Unit,Rent,Tenant Portion,Subsidy\nAnn,1,300,300,700\nBob,2,1000,300,700\nCy,3,300,,700\n") == ["1000.00", "1000", "300"]
    assert rents("Tenant,Unit,Rent,Tenant Share\nAnn,1,500,200\nBob,2,,200\n") == ["500", "200"]


def test_charges_are_folded_under_their_unit():
    text = "Unit,Resident,Charge Code,Amount\n101,Ann Lee,RENT,\"1,200.00\"\n,,Pet Rent,50\n,,CONC-movein,-100.00\n,,Total,1150\n102,Bob,rent,900\n,,Rent,(25.00)\n103,VACANT,,\n104,Cy,trash,20\n"
    rows = delimited.parse_file("f", text.encode())
    assert [(r["unit"], r["rent"], r["concession"], r["skip_reason"]) for r in rows] == [("101", "1200.00", "100.00", None), ("102", "875.00", "0.00", None), ("103", None, None, "no tenant"), ("104", "0.00", "0.00", None)]


def test_concession_columns_are_read():
    rows = delimited.parse_file("f", b"Tenant,Rent,Concessions\nAnn,900,75\nBob,800,\n")
    assert [(r["rent"], r["concession"]) for r in rows] == [("900", "75"), ("800", None)]
