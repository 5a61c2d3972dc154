"""Codes, positions, formats and labels that results must carry exactly."""

# 1-based character positions of the parts of a storage address.
ADDRESS_PARTS = {
    "area": (1, 2),
    "zone": (4, 4),
    "aisle": (6, 8),
    "module": (10, 12),
    "floor": (14, 15),
}

# Market of a site, by the prefix of the site code; anything else is the default.
MARKET_PREFIXES = {"BR": "BR", "MX": "MX"}
MARKET_DEFAULT = "OTHER"
MARKETS = ("BR", "MX", "OTHER")

# Divergence types, in display order.
LOST = "Lost"
FOUND = "Found"
OK = "ok"
DIVERGENCE_ORDER = (LOST, FOUND)

# Month labels, January to December.
MONTH_LABELS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")

# Goal marks and accuracy verdicts.
GOAL_MARK = "*****"
TARGET_MET = "OK"
TARGET_MISSED = "NotOK"

# Movement processes and the open status of a cycle count.
CYCLE_COUNT = "Cycle count"
PUT_AWAY = "Put away"
WORKING = "working"

# A process is named by its leading run of non-space characters.
FIRST_WORD = r"^[^\s]+"

# Text formats of dates and times, and the mark of a missing field.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"
STRICT_TIMESTAMP = r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$"
# Year, month, day with any separators and without; day, month, year, hour, minute, second likewise.
LOOSE_DATES = (r"^\s*(\d{4}|\d{2})\D+(\d{1,2})\D+(\d{1,2})\s*$", r"^\s*(\d{4}|\d{2})(\d{2})(\d{2})\s*$")
LOOSE_TIMESTAMPS = (
    r"^\s*(\d{1,2})\D+(\d{1,2})\D+(\d{4}|\d{2})\D+(\d{1,2})\D+(\d{1,2})\D+(\d{1,2})\s*$",
    r"^\s*(\d{2})(\d{2})(\d{4}|\d{2})\D*(\d{2})(\d{2})(\d{2})\s*$",
)
LAST_SHORT_YEAR = 68
MISSING = "NA"

# Texts of labels, around the values shown in them.
SITE_ERRORS_LABEL = "{site} (Tuplas error {errors})"
SITE_STOCK_LABEL = "{site} (Tuplas error {errors})\nAddress stock >= {edge} tuplas {share}"
BUCKET_LABEL = "{errors}\n {share}"
SITE_IMPACT_LABEL = "{site}    ({error_share})\nTarget {target}\n{goal} INAC {accuracy}"
AREA_IMPACT_LABEL = "{area}({error_share})"
TOTAL_LABEL = "Total"

# Default cuts and sizes of the reports.
MAX_LEVEL = 7
MAX_DENSITY = 7
DENSE_FROM = 5
FIRST_DENSITIES = 7
FLAGGED_RANKS = 2
FIRST_AISLES = 10
TOP_FLOORS = 5
TOP_SPREAD_SKUS = 123
SKIPPED_SPREAD_ROWS = 10
FIRST_SPREAD_ROWS = 20
TOP_ADDRESSES = 50
TOP_ONHAND_LINES = 6
TOP_INSURED_FRACTION = 0.01
BOX_UPPER = 20
WHISKER_REACH = 1.5

# Column names of the CSV extracts, by the input they fill. The names of the
# cycle summary are as in its header; the others are after cleaning.
EXTRACT_COLUMNS = {
    "cycle_summary": {
        "cycle_count_id": "cycle_count_id",
        "warehouse_id": "site_id",
        "area": "area",
        "level": "level",
        "region": "region",
        "mes": "period",
        "SHP_CC_CYCLE_COUNT_STATUS": "status",
        "population_size": "population_size",
        "p_hat": "p_hat",
        "acuracidade": "accurate_tuples",
        "tuplas_contadas_error": "error_tuples",
        "TARGET_SITE": "target_site",
        "TARGET_REGION": "target_region",
    },
    "count_detail": {
        "warehouse_id": "site_id",
        "area": "area",
        "level": "level",
        "shp_warehouse_address": "address_id",
        "shp_inventory_id": "sku_id",
        "qty_system": "qty_system",
        "count_unit_ok": "qty_counted",
        "divergencia_tt": "divergence_stored",
        "data_criacao": "counted_on",
        "categ_1": "category",
    },
    "address_stock": {
        "address": "address_id",
        "inventory_id": "sku_id",
        "cantidad_total": "units",
        "ultima_actualizacion": "updated_text",
        "vendedor": "seller_id",
        "valor_de_seguro": "insured_value",
    },
    "onhand": {
        "fbm_adddress_id": "address_id",
        "warehouse_id": "site_id",
        "qtde": "units",
    },
    "address_density": {
        "warehouse_id": "site_id",
        "fbm_address_id": "address_id",
        "sku": "sku_count",
    },
    "movements": {
        "proceso": "process",
        "cantidad": "units",
        "codigo_ml": "item_id",
        "origen": "origin",
        "destino": "destination",
        "fecha": "moved_text",
        "responsable": "worker_id",
    },
}
