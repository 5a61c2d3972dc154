"""CSV extracts, column names, tagging and the landed tables."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from stockaudit.sources import derived, readers, schemas


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_snake_case():
    names = {
        "SHP_CC_CYCLE_COUNT_STATUS": "shp_cc_cycle_count_status", "Código ML": "codigo_ml", "Categ 1": "categ_1",
        "warehouseId": "warehouse_id", "%share": "percent_share", "2nd": "x2nd", "  Área  ": "area", "": "x",
        "FBMAddress": "fbm_address", "qty#": "qty_number",
    }
    assert {name: readers.snake_case(name) for name in names} == names


def test_clean_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a.b", "A B"])
    assert readers.clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]


def test_summary_reader_turns_empty_into_null(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'TARGET_SITE,area,level\n0.8,MZ,1\nNA,,x\n,"",NA\n"0.5","a,b",3\n')
    schema = T.StructType([
        T.StructField("area", T.StringType()), T.StructField("target_site", T.DoubleType()),
        T.StructField("level", T.IntegerType()),
    ])
    got = readers.read_summary(spark, path, schema, rename={"TARGET_SITE": "target_site"})
    assert got.schema.names == ["area", "target_site", "level"]
    assert [tuple(row) for row in got.collect()] == [("MZ", 0.8, 1), (None, None, None), (None, None, None), ("a,b", 0.5, 3)]


def test_extract_reader_keeps_empty_text(spark, tmp_path):
    text = "Proceso,Cantidad,Código ML,Origen,Destino,Fecha,Responsable\n"
    text += "Put away,2,7,MU-0,,15/01/2024 10:00:00,5\n adjustment,x,NA,\"\",NA,,\n"
    rename = {
        "proceso": "process", "cantidad": "units", "codigo_ml": "item_id", "origen": "origin",
        "destino": "destination", "fecha": "moved_text", "responsable": "worker_id",
    }
    got = readers.read_extract(spark, write(tmp_path / "m.csv", text), schemas.MOVEMENTS, rename)
    assert [tuple(row) for row in got.collect()] == [
        ("Put away", 2, 7, "MU-0", "", "15/01/2024 10:00:00", 5),
        (" adjustment", None, None, "", None, "", None),
    ]


def test_reader_names_missing_columns(spark, tmp_path):
    path = write(tmp_path / "o.csv", "address,warehouse\nMZ,BR01\n")
    with pytest.raises(ValueError, match="units"):
        readers.read_extract(spark, path, schemas.ONHAND, {"address": "address_id", "warehouse": "site_id"})


def test_csv_scan_reads_only_needed_columns(spark, tmp_path):
    path = write(tmp_path / "o.csv", "address_id,site_id,units\nMZ,BR01,4\n")
    plan = readers.read_extract(spark, path, schemas.ONHAND).select("units")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<units:string>" in plan


def test_union_sources_tags_and_fills(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2.0)], "t string, extra double")
    got = readers.union_sources({"sp02": a, "sp04": b}, "site_id").select("n", "t", "extra", "site_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "x", None, "sp02"), (None, "y", 2.0, "sp04")], key=repr
    )


def test_relocate(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"])
    assert readers.relocate(df, "c", before="a").columns == ["c", "a", "b"]


def test_landed_tables_have_their_schema_and_all_rows(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name, (_, schema, _, _) in derived.BUILDERS.items():
        table = derived.table(spark, sf_dir, name)
        assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in schema], name
        if name in ("count_detail", "address_stock", "onhand"):
            assert table.count() == lines, name
    extracts = derived.address_stock_sources(spark, sf_dir)
    assert sum(df.count() for df in extracts.values()) == lines


def test_tables_land_side_by_side(spark, sf_dir, tmp_path):
    import os

    for name in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    before = set(derived._written)
    derived.land_all(spark, str(tmp_path))
    landed = [name for _, folder, name in set(derived._written) - before if folder == str(tmp_path)]
    assert sorted(landed) == sorted([*derived.BUILDERS, "address_id_numbers", "sku_id_numbers"])
    for name in derived.BUILDERS:
        mine, other = derived.table(spark, str(tmp_path), name), derived.table(spark, sf_dir, name)
        columns = [c for c in mine.columns if c not in schemas.NUMBERS.values()]
        assert mine.select(columns).exceptAll(other.select(columns)).isEmpty() and mine.count() == other.count()


def test_a_table_is_landed_once(spark, sf_dir):
    first = derived.movements(spark, sf_dir).inputFiles()
    assert derived.movements(spark, sf_dir).inputFiles() == first


def test_a_null_site_survives_landing(spark, tmp_path):
    df = spark.createDataFrame([("MZ-a", None, 1), ("MZ-b", "BR01", 2)], schemas.ONHAND)
    derived.land(df, str(tmp_path / "onhand"), "site_id")
    got = derived.read_landed(spark, str(tmp_path / "onhand"), schemas.ONHAND)
    assert sorted(map(tuple, got.collect())) == [("MZ-a", None, 1), ("MZ-b", "BR01", 2)]
    assert got.where(F.col("site_id").startswith("BR")).count() == 1


CSV = {
    "cycle_summary": "cycle_count_id,warehouse_id,area,level,region,mes,SHP_CC_CYCLE_COUNT_STATUS,population_size,p_hat,"
    "acuracidade,tuplas_contadas_error,TARGET_SITE,TARGET_REGION\nc1,BR01,MZ,1,BR,2024 | 02,working,100.0,0.1,90.5,10,0.8,0.7\n",
    "count_detail": "warehouse_id,area,level,shp warehouse address,shp_inventory_id,qty_system,count_unit_ok,divergencia_tt,"
    "data_criacao,categ_1\nBR01,MZ,1,MZ-0-000-000-01,AB12,5,6,1,2024-02-05,toys\nBR01,MZ,1,MZ-0-000-000-01,AB13,5,NA,NA,2024/3/5,\n",
    "onhand": "fbm_adddress_id,warehouse_id,qtde\nMZ-0-000-000-01,BR01,3.5\n",
    "address_density": "Warehouse ID,FBM Address ID,SKU\nBR01,MZ-0-000-000-01,6\n",
    "movements": "Proceso,Cantidad,Codigo ML,Origen,Destino,Fecha,Responsable\nPicking,2,AB12,MZ-1,,15/01/2024 10:00:00,ana\n",
}


def test_inputs_are_read_by_their_original_headers(spark, tmp_path):
    got = {
        name: [tuple(row) for row in readers.read_input(spark, name, write(tmp_path / f"{name}.csv", text)).collect()]
        for name, text in CSV.items()
    }
    assert got == {
        "cycle_summary": [("c1", "BR01", "MZ", 1, "BR", "2024 | 02", "working", 100, 0.1, 90.5, 10, 0.8, 0.7)],
        "count_detail": [
            ("BR01", "MZ", 1, "MZ-0-000-000-01", "AB12", 5, 6, 1, "2024-02-05", "toys", datetime.date(2024, 2, 5), 2),
            ("BR01", "MZ", 1, "MZ-0-000-000-01", "AB13", 5, None, None, "2024/3/5", "", datetime.date(2024, 3, 5), 3),
        ],
        "onhand": [("MZ-0-000-000-01", "BR01", None)],
        "address_density": [("BR01", "MZ-0-000-000-01", 6)],
        "movements": [("Picking", 2, "AB12", "MZ-1", "", "15/01/2024 10:00:00", "ana", datetime.datetime(2024, 1, 15, 10), datetime.date(2024, 1, 15))],
    }


def test_reports_run_on_extracts(spark, tmp_path):
    from stockaudit.plans import accuracy, divergence, layout, movement

    read = {name: readers.read_input(spark, name, write(tmp_path / f"{name}.csv", text)) for name, text in CSV.items()}
    row = divergence.density_frequency(read["count_detail"], "MZ").collect()[0]
    assert (row["site_label"], row["density"], row["errors"]) == ("BR01 (Tuplas error 1)", 1, 1)
    assert accuracy.site_table(read["cycle_summary"], "BR", "2024 | 02", "MZ", "BR").count() == 2
    assert accuracy.impact(read["cycle_summary"], "BR", "2024 | 02").collect()[0]["site_label"] == (
        "BR01    (100.0%)\nTarget 80.00%\n***** INAC 90.50%"
    )
    assert movement.touch_levels(read["movements"], "MZ").collect()[0]["touches"] == 1
    header = "Address,Inventory ID,Cantidad Total,Última Actualización,Vendedor,Valor de seguro\n"
    stock = readers.read_address_stock(spark, {
        "sp02": write(tmp_path / "a.csv", header + "MZ-0-000-000-01,AB12,4,01/02/2024 00:00:00,9,1.5\n"),
        "sp04": write(tmp_path / "b.csv", header + "MZ-0-000-000-01,AB12,6,01/02/2024 00:00:00,9,\n"),
    })
    assert {row["site_id"]: row["units"] for row in layout.site_units(stock).collect()} == {"sp02": 4, "sp04": 6}
    assert layout.insured_mean(stock).collect()[0][0] == 1.5


def test_lines_without_a_site_are_an_extract_of_their_own(spark, monkeypatch):
    from stockaudit.plans import layout

    rows = [("BR01", "MZ-1", 1, 2, "n/a", 3, 1.0), (None, "MZ-2", 1, 5, "n/a", 3, 1.0)]
    stock = spark.createDataFrame(rows, schemas.ADDRESS_STOCK)
    monkeypatch.setattr(derived, "address_stock", lambda spark, sf_dir: stock)
    parsed = layout.parsed(derived.address_stock_sources(spark, ""))
    assert sorted(((r.site_id, r.units) for r in parsed.collect()), key=repr) == [("BR01", 2), (None, 5)]


# --- landing without long shuffles ------------------------------------------------------------


def _odd_items(spark, folder):
    """Repeated and missing part keys, missing order keys, a SKU and an address that many lines share, SKUs that are unknown in all lines."""
    items = spark.range(4000).selectExpr(
        "if(id % 41 = 0, null, if(id % 3 = 0, 5, id div 7)) AS l_orderkey",
        "if(id % 37 = 0, null, if(id % 4 = 0, 8, id % 90)) AS l_partkey",
        "id % 11 AS l_suppkey", "cast(if(id % 53 = 0, null, id % 7 + 1) AS int) AS l_linenumber",
        "cast(id % 50 AS double) AS l_quantity", "cast(id % 1000 AS double) AS l_extendedprice",
        "timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(cast(id % 60 AS int)) AS l_shipdate",
    )
    items.unionAll(items.limit(50)).write.parquet(f"{folder}/lineitem.parquet")
    parts = spark.range(120).selectExpr("if(id % 10 = 9, null, id div 2 + 3) AS p_partkey", "concat('type ', id % 6) AS p_type")
    parts.write.parquet(f"{folder}/part.parquet")


def test_landed_lines_are_those_of_a_plain_join(spark, tmp_path):
    _odd_items(spark, str(tmp_path))
    items, parts = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("lineitem", "part"))
    wanted = derived._counted(derived._placed(items.join(parts, items["l_partkey"] == parts["p_partkey"], "left")))
    landed = derived.count_detail(spark, str(tmp_path))
    got = landed.select(*wanted.columns)
    assert got.count() == wanted.count() > items.count()
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    stock = derived.address_stock(spark, str(tmp_path))
    assert stock.count() == items.count()
    for lines in (landed, stock):
        for column, number in schemas.NUMBERS.items():
            pairs = lines.select(column, number).distinct()
            known = pairs.where(F.col(column).isNotNull())
            assert known.count() == known.select(column).distinct().count() == known.select(number).distinct().count()
            assert {r[1] for r in pairs.where(F.col(column).isNull()).collect()} <= {0}
    density = derived.address_density(spark, str(tmp_path))
    by_hand = landed.groupBy("site_id", "address_id").agg(F.count_distinct("sku_id").alias("sku_count"))
    assert density.exceptAll(by_hand).isEmpty() and by_hand.exceptAll(density).isEmpty()
    summary = derived.cycle_summary(spark, str(tmp_path))
    assert summary.agg(F.sum("population_size")).first()[0] == landed.count()


def test_small_inputs_land_no_lines(spark, tmp_path):
    _odd_items(spark, str(tmp_path))
    derived.cycle_summary(spark, str(tmp_path))
    derived.address_density(spark, str(tmp_path))
    assert {name for _, folder, name in derived._written if folder == str(tmp_path)} == {"cycle_summary", "address_density"}


@pytest.mark.parametrize("name", ["count_detail", "address_stock"])
def test_lines_are_shuffled_twice_as_they_are_given(name, spark, sf_dir, monkeypatch):
    plans, once = [], derived._once
    monkeypatch.setattr(derived, "_once", lambda s, d, n, write: write(n) if n == name else once(s, d, n, write))
    monkeypatch.setattr(derived, "land", lambda df, *_, spread=False, **__: plans.append((spread, df._jdf.queryExecution().executedPlan().toString())))
    monkeypatch.setattr(derived, "read_landed", lambda *_: None)
    derived.table(spark, sf_dir, name)
    (spread, text), = plans
    assert spread and "BroadcastHashJoin" not in text
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("hashpartitioning(l_partkey" in line for line in shuffled) == 1
    assert sum("hashpartitioning(address_id" in line for line in shuffled) == 1
    assert not any("hashpartitioning(sku_id" in line for line in shuffled)
