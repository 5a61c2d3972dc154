"""Extracts whose files are written differently read as one table."""

import pytest
from pyspark.sql import functions as F

from stockaudit.sources import dialects, readers, schemas

HEADER = ["Address", "Inventory ID", "Cantidad Total", "Última Actualización", "Vendedor", "Valor de seguro"]


def line(separator, *fields):
    return separator.join(f'"{f}"' if separator in f else f for f in fields) + "\n"


def write(path, separator, rows, encoding="utf-8", header=HEADER):
    path.write_bytes((line(separator, *header) + "".join(line(separator, *row) for row in rows)).encode(encoding))


def test_a_folder_of_mixed_files(spark, tmp_path):
    write(tmp_path / "a.csv", ",", [["MZ-1", "A1", "4", "01/02/2024 00:00:00", "9", "0.05"], ["MZ-2", "A2", "1,000", "", "9", "1,234.5"]])
    write(tmp_path / "b.csv", ";", [["MZ-3", "A3", "5", "", "9", "0,05"], ["MZ-4", "A4", "2.000", "", "9", "1.234,5"]])
    write(tmp_path / "c d.csv", "\t", [["MZ-5", "Á5", "6,0", "", "", "12,50"]], "latin-1")
    write(tmp_path / "e.csv", "|", [["MZ-6", "A6", "7", "", "9", "NA"]], "utf-8-sig")
    write(tmp_path / "f.csv", ";", [["1,5", "9", "", "8", "A7", "MZ-7"]], header=HEADER[::-1])
    (tmp_path / "empty.csv").write_text("")
    stock = readers.read_input(spark, "address_stock", str(tmp_path))
    got = {r.address_id: (r.sku_id, r.units, r.seller_id, r.insured_value) for r in stock.collect()}
    assert got == {
        "MZ-1": ("A1", 4, "9", 0.05), "MZ-2": ("A2", 1000, "9", 1234.5), "MZ-3": ("A3", 5, "9", 0.05),
        "MZ-4": ("A4", 2000, "9", 1234.5), "MZ-5": ("Á5", 6, "", 12.5), "MZ-6": ("A6", 7, "9", None), "MZ-7": ("A7", 8, "9", 1.5),
    }
    assert stock.agg(F.count("updated_at")).first()[0] == 1
    sites = readers.read_address_stock(spark, {"sp": [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "rj": str(tmp_path / "c*.csv")})
    assert sorted((r.site_id, r.address_id) for r in sites.collect()) == [("rj", "MZ-5"), *[("sp", f"MZ-{i}") for i in range(1, 5)]]


@pytest.mark.parametrize("separator", dialects.SEPARATORS)
def test_quoted_separators_do_not_count(separator):
    other = ";" if separator == "," else ","
    head = f'"a{other}b{other}{other}"{separator}c\n1{separator}2\n'.encode()
    assert dialects.dialect_of(head).separator == separator


@pytest.mark.parametrize("head,decimal", [
    (b"a;b\n1;2\n", ","), (b"a,b\n1,2\n", "."), (b"a;b\n1.5;2\n", "."), (b'a,b\n"0,05",2\n', ","),
    (b"a;b\n1.234,5;2\n", ","), (b"a;b\n1,234.5;2\n", "."), (b"a\tb\n", "."), (b"", "."),
])
def test_decimal_sign(head, decimal):
    assert dialects.dialect_of(head).decimal == decimal
    assert dialects.dialect_of(head, decimal=".").decimal == "."


def test_a_head_may_end_within_a_letter_or_a_line():
    head = ("a;b\n" + "é;1,5\n" * 10_000).encode()[: dialects.HEAD_BYTES]
    for cut in range(4):
        told = dialects.dialect_of(head[: len(head) - cut] if cut else head)
        assert (told.encoding, told.decimal, told.header) == ("UTF-8", ",", ("a", "b"))
    assert dialects.dialect_of("é;1\n".encode("latin-1") * 9).encoding == "ISO-8859-1"


@pytest.mark.parametrize("text,decimal,number", [
    ("0,05", ",", 0.05), ("0.05", ",", 0.05), ("1.234,5", ",", 1234.5), ("1.234", ",", 1234.0), ("-1.234.567", ",", -1234567.0),
    ("1,234", ".", 1234.0), ("0,05", ".", None), ("1.5", ".", 1.5), ("1e3", ".", 1000.0), (" 2 ", ",", 2.0), ("1,2,3", ",", None),
    (None, ",", None), ("", ".", None),
])
def test_numbers_as_written(spark, text, decimal, number):
    value = dialects.plain_number(F.lit(text).cast("string"), decimal).try_cast("double")
    assert spark.range(1).select(value.alias("x")).first().x == number


def test_no_file_with_a_header(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no file"):
        readers.read_extract(spark, str(tmp_path), schemas.ONHAND)
