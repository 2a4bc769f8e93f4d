"""SQL for sources, sinks, row operators, rollups, filters and scalar expressions."""

from __future__ import annotations

from checks.oracle import (
    CTES, REPORT_COLUMNS, REPORT_SQL, _I, _MECHANIC, _code_parts, _week, agg, sql,
)

_SUMS4 = ("SUM(Importe) AS Importe, SUM(Cantidad) AS Cantidad, "
          "SUM(Precio_x_Cant) AS Precio_x_Cant, SUM(Costo_total) AS Costo_total")
_OUT4 = "Importe Cantidad Precio_x_Cant Costo_total"
# The grouping keys of the rollup tables.
_ROLLUP_KEYS = {
    "ventas": ["Anio_mes", "Tiendas", "Categoria", "Cod_promo", "Nom_promo", "Tipo", "Sistema"],
    "productos": ["Anio_mes", "Cod_prod", "Nom_prod", "Categoria"],
    "promo_prod": ["Anio_mes", "Cod_prod", "Nom_prod", "Categoria", "has_promo"],
    "ventas_dia": ["Fecha", "Semana", "Anio_mes", "CicloAno_mes", "Categoria", "Cod_promo",
                   "Nom_promo", "Tipo"],
}


def _rollup(name: str, source: str) -> str:
    keys = ", ".join(_ROLLUP_KEYS[name])
    return f"SELECT {keys}, {_SUMS4} FROM {source} GROUP BY {keys}"


def _table_sums(lines: str, daily: str, tickets: str) -> str:
    parts = []
    for name, source in (("ventas", lines), ("productos", lines), ("promo_prod", lines),
                         ("ventas_dia", daily)):
        parts.append(f"SELECT '{name}' AS tabla, Anio_mes, COUNT(*) AS filas, SUM(Importe) AS total "
                     f"FROM ({_rollup(name, source)}) GROUP BY Anio_mes")
    parts.append("SELECT 'tickets', Anio_mes, COUNT(*), SUM(n_tickets) "
                 f"FROM {tickets} GROUP BY Anio_mes")
    return " UNION ALL ".join(parts)


_ALL_SUMS = _table_sums("lineas", "ventas_dia", "tickets")

# The batch of the month-replace query: one quarter without returned goods.
_KEPT = "(Anio_mes NOT IN ('2025-10', '2025-11', '2025-12') OR Tipo <> 'R')"
_MERGED = {
    "lineas_m": f"SELECT * FROM lineas WHERE {_KEPT}",
    "dia_m": f"SELECT * FROM ventas_dia WHERE {_KEPT}",
    "tickets_m": CTES["tickets"].replace("FROM lineas)", "FROM lineas_m)"),
}


def _catalog_rows(where: str = "TRUE") -> str:
    """First row per code of the catalogue file: names sorted, missing names last."""
    return f"""
        SELECT Cod_promo, NULLIF(nombre, '') AS Nom_promo,
               CASE WHEN nombre LIKE '2x%' THEN '2x' ELSE '3x' END AS Formato_promo,
               CASE WHEN nombre LIKE '2x%' THEN 2 WHEN nombre LIKE 'Combo%' THEN 1 ELSE 3 END
                   AS Unidades_por_promo
        FROM (SELECT Cod_promo, FIRST(Nom_promo ORDER BY Nom_promo NULLS LAST) AS nombre
              FROM codigos WHERE {where} GROUP BY Cod_promo)"""


_CRM = "Cod_promo LIKE '%-CRM'"
_CATALOG_OUT = "Cod_promo Nom_promo Formato_promo Unidades_por_promo"


def _exported(value: str) -> str:
    """Text of a number in an export: decimal comma, no zeros beyond the first decimal."""
    return (f"replace(regexp_replace(CAST(CAST({value} AS DECIMAL(38,4)) AS VARCHAR), "
            r"'(\.[0-9]+?)0+$', '\1'), '.', ',')")


def _bundle() -> str:
    shown = {
        "Resumen": ("evol_v", 5), "Categorias": ("treemap", 4), "SKU_Ranking": ("sku_ranking", 10),
        "Tiendas": ("tiendas_v", 8), "Promociones": ("promos", 11), "YoY": ("yoy_mes", 8),
        "Datos": ("resumen_export", 12),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS tabla, COUNT(*) AS filas, {n} AS columnas, SUM(Ingresos) AS Ingresos "
        f"FROM r_{report}" for name, (report, n) in shown.items())


# --- filters ----------------------------------------------------------------------------------

_CYCLE_MONTHS = "Anio_mes IN (SELECT Anio_mes FROM meses_ciclo WHERE {})"


def _stores(where: str) -> str:
    return f"Tiendas IN (SELECT FileCORR FROM tiendas WHERE {where})"


def _effect(table: str, where: str = "TRUE") -> str:
    """What the filter-effect queries return: monthly (and category) sums of one table."""
    if table.startswith("tickets"):
        return agg(table, "month", "Tickets Tkt_promo", where)
    return agg(table, "Anio_mes Categoria", "Ingresos Unidades", where)


_EFFECT = "Anio_mes Categoria Ingresos Unidades"
_EFFECT_T = "Anio_mes Tickets Tkt_promo"


def _matching(table: str, other: str, where: str) -> str:
    """Semi-join on (month, category), NULL matching NULL."""
    return (f"EXISTS (SELECT 1 FROM {other} AS o WHERE o.Anio_mes = {table}.Anio_mes AND "
            f"o.Categoria IS NOT DISTINCT FROM {table}.Categoria AND ({where}))")


_ATTRIBUTES = _stores("Region IN ('ASIA', 'EUROPE') AND Formato = 'Express' AND Segmento IN ('A', 'B')")
_F08 = _stores("Region = 'ASIA'") + " AND Tipo = 'R' AND PromoNum = '09'"
_F09 = "regexp_matches(Nom_prod, '^cold', 'i') AND Anio_mes LIKE '2025-%'"
_F09_CODE = "regexp_matches(Cod_prod, '^1.7$')"
_C4 = _CYCLE_MONTHS.format("ciclo = 'C4'")
# Sales of store 3 that share month and category with 'cold rod' products sold where store 3 sells.
_F10_CTES = {
    "v10": f"SELECT * FROM ventas WHERE Tiendas = '3' AND {_C4}",
    "p10": f"SELECT * FROM productos WHERE Nom_prod = 'cold rod' AND {_C4} AND "
           + _matching("productos", "v10", "TRUE"),
    "w10": "SELECT * FROM v10 WHERE " + _matching("v10", "p10", "TRUE"),
    "pp10": f"SELECT * FROM promo_prod WHERE Nom_prod = 'cold rod' AND {_C4} AND "
            + _matching("promo_prod", "w10", "TRUE"),
}
_F09_CTES = {
    "p09": f"SELECT * FROM productos WHERE {_F09}",
    "v09": "SELECT * FROM ventas WHERE Anio_mes LIKE '2025-%' AND " + _matching("ventas", "p09", "TRUE"),
    "t09": "SELECT * FROM tickets WHERE Anio_mes LIKE '2025-%' AND Anio_mes IN "
           "(SELECT Anio_mes FROM p09)",
}
_F08_CTES = {
    "v08": f"SELECT * FROM ventas WHERE {_F08}",
    "p08": "SELECT * FROM productos WHERE " + _matching("productos", "v08", "TRUE"),
}


def _facets() -> str:
    lists = [("Anio_mes", "ventas", "Anio_mes"), ("Categoria", "ventas", "Categoria"),
             ("Tipo", "ventas", "Tipo"), ("Sistema", "ventas", "Sistema"),
             ("Tiendas", "ventas", "Tiendas"), ("TipoPromo", "ventas", "NULLIF(TipoPromo, '')"),
             ("CicloAno_p", "ventas", "NULLIF(CicloAno_p, '')"),
             ("PromoNum", "ventas", "NULLIF(PromoNum, '')"), ("Region", "tiendas", "Region"),
             ("Comuna", "tiendas", "Comuna"), ("Formato", "tiendas", "Formato"),
             ("Segmento", "tiendas", "Segmento"), ("Nom_prod", "productos", "Nom_prod"),
             ("Anio", "ventas", "left(Anio_mes, 4)")]
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS columna, {e} AS valor FROM {table} WHERE {e} IS NOT NULL"
        for name, table, e in lists)


def rows_and_filters() -> dict[str, str]:
    number_out = "Cantidad Precio Importe"
    out = {
        "s01_sales_csv_scan": sql(
            "Tiendas Transaccion Fecha_raw Cod_prod Nom_prod Categoria c1 c2 c3 Cod_promo Nom_promo "
            "c4 Tipo Sistema",
            "SELECT *, Cantidad AS c1, Precio AS c2, Importe AS c3, Costo_unit AS c4 FROM texto"),
        "s01_quoted_line_breaks": sql(
            "Tiendas Transaccion Fecha_raw Cod_prod Nom_prod Categoria c1 c2 c3 Cod_promo Nom_promo "
            "c4 Tipo Sistema",
            "SELECT * REPLACE (CASE WHEN CAST(Cod_prod AS INT) % 7 = 0 THEN coalesce(Nom_prod, '') || chr(10) || "
            "'de \"' || Cod_prod || '\";' || chr(10) ELSE Nom_prod END AS Nom_prod), "
            "Cantidad AS c1, Precio AS c2, Importe AS c3, Costo_unit AS c4 FROM texto"),
        "s02_rollup_scan": sql(
            "tabla filas total",
            f"SELECT tabla, SUM(filas) AS filas, SUM(total) AS total FROM ({_ALL_SUMS}) "
            "GROUP BY tabla UNION ALL SELECT 'nada', 0, NULL"),
        "s03_catalog_load": sql(_CATALOG_OUT, _catalog_rows()),
        "s04_store_load": sql(
            "FileCORR Region Comuna Formato Segmento",
            "SELECT CASE WHEN Formato = 'Kiosco' THEN 'K' || FileCORR ELSE FileCORR END AS FileCORR, "
            "Region, Comuna, Formato, Segmento FROM tiendas"),
        "s05_rollup_write": sql("tabla Anio_mes filas total", _ALL_SUMS),
        "s06_month_replace": sql(
            "tabla Anio_mes filas total", _table_sums("lineas_m", "dia_m", "tickets_m"), **_MERGED),
        "s07_export_summary_csv": sql(
            "Anio_mes Tiendas Categoria Tipo Sistema n1 n2 n3 n4 n5",
            f"SELECT *, {_exported('Ingresos')} AS n1, {_exported('Unidades')} AS n2, "
            f"{_exported('Costo')} AS n3, {_exported('Margen')} AS n4, "
            f"{_exported('Margen_pct')} AS n5 FROM r_resumen_export"),
        "s07_export_products_csv": sql(
            "Anio_mes filas Ingresos",
            f"SELECT Anio_mes, COUNT(*) AS filas, SUM(Importe) AS Ingresos FROM "
            f"({_rollup('productos', 'productos')}) GROUP BY 1"),
        "s08_report_bundle": sql("tabla filas columnas Ingresos", _bundle()),
        "s09_catalog_override": sql(
            _CATALOG_OUT + " origen",
            f"SELECT *, 'propio' AS origen FROM ({_catalog_rows(_CRM)})"
            f" UNION ALL SELECT *, 'inexistente' FROM ({_catalog_rows()})"
            f" UNION ALL SELECT *, 'defecto' FROM ({_catalog_rows()})"),
        "n01_dated_lines": sql(
            "Transaccion Cod_prod Fecha_raw",
            "SELECT * FROM texto WHERE length(trim(Fecha_raw)) = 8"),
        "n02_month_and_day": sql(
            "Anio_mes Fecha lineas", "SELECT Anio_mes, Fecha, COUNT(*) AS lineas FROM limpio GROUP BY ALL"),
        "n03_week_label": sql(
            "Fecha Semana lineas",
            f"SELECT Fecha, {_week('Fecha')} AS Semana, COUNT(*) AS lineas FROM limpio GROUP BY ALL"),
        "n04_numeric_text": sql(
            "Transaccion Cod_prod " + number_out + " c4",
            "SELECT *, ROUND(CAST(Costo_unit AS DOUBLE), 4) AS c4 FROM limpio"),
        "n04_rejected_amounts": sql(
            "Transaccion Cod_prod Columna Motivo",
            "SELECT Transaccion, Cod_prod, 'Importe' AS Columna, 'number too large' AS Motivo "
            "FROM limpio WHERE CAST(Cod_prod AS INT) % 83 = 0 UNION ALL "
            "SELECT Transaccion, Cod_prod, 'Precio_x_Cant', 'product too large' "
            "FROM limpio WHERE CAST(Cod_prod AS INT) % 79 = 0"),
        "n05_loaded_without_rejected": sql(
            "Anio_mes Ingresos Unidades",
            "SELECT Anio_mes, SUM(Importe) AS Ingresos, SUM(Cantidad) AS Unidades FROM limpio "
            "WHERE CAST(Cod_prod AS INT) % 83 <> 0 AND CAST(Cod_prod AS INT) % 79 <> 0 GROUP BY 1"),
        "n05_line_extensions": sql(
            "Cod_prod " + _OUT4,
            "SELECT Cod_prod, SUM(Importe) AS Importe, SUM(Cantidad) AS Cantidad, "
            "SUM(CAST(Precio AS DECIMAL(19,4)) * CAST(Cantidad AS DECIMAL(19,4))) AS Precio_x_Cant, "
            "SUM(CAST(Costo_unit AS DECIMAL(19,4)) * CAST(Cantidad AS DECIMAL(19,4))) AS Costo_total "
            "FROM limpio GROUP BY 1"),
        "n06_promo_flag": sql(
            "Cod_promo Nom_promo has_promo lineas",
            "SELECT Cod_promo, Nom_promo, CASE WHEN Cod_promo IS NULL THEN 0 ELSE 1 END AS has_promo, "
            "COUNT(*) AS lineas FROM limpio GROUP BY ALL"),
        "n07_excluded_categories": sql(
            "Categoria lineas", "SELECT Categoria, COUNT(*) AS lineas FROM ventas GROUP BY 1"),
        "n08_store_code": sql(
            "Tiendas lineas", "SELECT trim(Tiendas) AS Tiendas, COUNT(*) AS lineas FROM texto GROUP BY 1"),
        "d01_cycle_calendar": sql(
            "ciclo anio ini fin meses Ingresos",
            "SELECT c.ciclo, anio, CAST(ini AS VARCHAR) AS ini, CAST(fin AS VARCHAR) AS fin, "
            "NULLIF(COUNT(DISTINCT v.Anio_mes), 0) AS meses, SUM(Importe) AS Ingresos "
            "FROM ciclos c LEFT JOIN meses_ciclo m ON m.CicloAno_mes = c.ciclo || '-' || c.anio "
            "LEFT JOIN ventas v ON v.Anio_mes = m.Anio_mes GROUP BY ALL"),
        "d02_month_cycle": sql(
            "Anio_mes CicloAno_mes ciclo Ingresos",
            "SELECT COALESCE(m.Anio_mes, v.Anio_mes) AS Anio_mes, CicloAno_mes, ciclo, Ingresos "
            "FROM meses_ciclo m FULL JOIN (SELECT Anio_mes, SUM(Importe) AS Ingresos FROM ventas "
            "GROUP BY 1) v ON m.Anio_mes = v.Anio_mes"),
        "d03_attach_cycle": sql(
            "Anio_mes CicloAno_mes lineas",
            "SELECT Anio_mes, CicloAno_mes, COUNT(*) AS lineas FROM ventas_dia GROUP BY 1, 2"),
        "d04_promo_code_parts": sql(
            "Cod_promo CicloNum_p CicloAno_p PromoAno PromoNum TipoPromo Ingresos",
            f"SELECT Cod_promo, {_code_parts('Cod_promo')}, {_I} AS Ingresos FROM ventas GROUP BY Cod_promo"),
        "d05_promo_mechanic": sql(
            "Nom_promo Mecanica Ingresos",
            f"SELECT Nom_promo, {_MECHANIC} AS Mecanica, {_I} AS Ingresos FROM ventas GROUP BY Nom_promo"),
        "a05_tickets": sql("Anio_mes Tiendas n_tickets n_tkt_promo", "SELECT * FROM tickets"),
        "a06_daily": sql(
            "Periodo " + _OUT4, f"SELECT Fecha AS Periodo, {_SUMS4} FROM ventas_dia GROUP BY 1"),
        "a06_weekly_by_category": sql(
            "Periodo Categoria " + _OUT4,
            f"SELECT Semana AS Periodo, Categoria, {_SUMS4} FROM ventas_dia GROUP BY 1, 2"),
        "a06_monthly_by_type": sql(
            "Periodo Tipo " + _OUT4,
            f"SELECT Anio_mes AS Periodo, Tipo, {_SUMS4} FROM ventas_dia GROUP BY 1, 2"),
        "a06_cycle": sql(
            "Periodo " + _OUT4,
            f"SELECT COALESCE(NULLIF(CicloAno_mes, ''), 'Sin ciclo') AS Periodo, {_SUMS4} "
            "FROM ventas_dia GROUP BY 1"),
        # filters
        "f00_facets": sql("columna valor", _facets()),
        "f01_cycle_numbers_and_years": sql(_EFFECT, _effect(
            "ventas", _CYCLE_MONTHS.format("ciclo IN ('C2', 'C3')")
            + " AND (Anio_mes LIKE '2024-%' OR Anio_mes LIKE '2025-%')")),
        "f01_months_and_cycle_year": sql(_EFFECT, _effect(
            "productos", "Anio_mes BETWEEN '2024-01' AND '2024-04' AND "
            + _CYCLE_MONTHS.format("CicloAno_mes = 'C1-2024'"))),
        "f01_empty_intersection": sql(_EFFECT, _effect("ventas", "FALSE")),
        "f02_categorical": sql(_EFFECT, _effect(
            "ventas", "Categoria IN ('Brand#11', 'Brand#12', 'Brand#13') AND Tipo <> 'R' AND Sistema = 'F'")),
        "f02_categorical_products": sql(_EFFECT, _effect(
            "productos", "Categoria IN ('Brand#11', 'Brand#12', 'Brand#13')")),
        "f03_text_search": sql(_EFFECT, _effect(
            "ventas", "Nom_promo ILIKE '%lleva%' OR Nom_promo ILIKE '%combo%'")),
        "f04_promo_code": sql(_EFFECT, _effect(
            "ventas", "TipoPromo IN ('CIRM', 'CRG') AND CicloAno_p IN ('C1-2024', 'C2-2025') "
            "AND PromoNum IN ('05', '06')")),
        "f05_store_attributes": sql(_EFFECT, _effect("ventas", _ATTRIBUTES)),
        "f05_store_attributes_tickets": sql(_EFFECT_T, _effect("tickets", _ATTRIBUTES)),
        "f05_no_such_store": sql(_EFFECT, _effect("ventas")),
        "f06_stores": sql(_EFFECT, _effect("ventas", "Tiendas IN ('1', '5', '7')")),
        "f06_stores_tickets": sql(_EFFECT_T, _effect("tickets", "Tiendas IN ('1', '5', '7')")),
        "f07_products": sql(_EFFECT, _effect("productos", "Nom_prod IN ('cold anvil', 'large rod')")),
        "f08_stores_to_products": sql(_EFFECT, _effect("p08"), **_F08_CTES),
        "f09_products_to_sales": sql(_EFFECT, _effect("v09"), **_F09_CTES),
        "f09_products_to_tickets": sql(
            _EFFECT_T, agg("t09", "month", "Tickets Tkt_promo"), **_F09_CTES),
        "f09_product_code": sql(_EFFECT, _effect("ventas", _matching("ventas", "productos", _F09_CODE))),
        "f09_no_such_product": sql(_EFFECT, _effect("ventas")),
        "f10_sales_to_promo_products": sql(_EFFECT, _effect("pp10"), **_F10_CTES),
        "f11_promo_only": sql("Tipo Ingresos N_promos",
                              agg("ventas", "Tipo", "Ingresos N_promos", "Cod_promo IS NOT NULL")),
        "f12_having": sql("Producto Categoria Ingresos", "SELECT * FROM r_desc_mg_prod"),
        "f13_between": sql("Producto Categoria Ingresos Mg_pct",
                           "SELECT * FROM r_alertas WHERE Mg_pct >= 0 AND Mg_pct <= 0.25"),
        "f14_drop_null": sql(
            "Categoria Ingresos Unidades N_promos",
            agg("ventas", "Categoria", "Ingresos Unidades N_promos",
                "Categoria IS NOT NULL AND Cod_promo IS NOT NULL")),
        # scalar expressions
        "x01_product_label": sql("Producto Ingresos", agg("productos", "prod", "Ingresos")),
        "x02_promo_label": sql("Promo Ingresos", agg("ventas", "promo", "Ingresos")),
        "x03_category_label": sql(
            "Cat_guion Cat_sin Ingresos",
            f"SELECT COALESCE(Categoria, '–') AS Cat_guion, COALESCE(Categoria, 'Sin cat.') AS Cat_sin, "
            f"{_I} AS Ingresos FROM ventas GROUP BY 1, 2"),
        "x04_text_functions": sql(
            "Nom_promo mayus minus inicio largo cambio palabra es_2x es_off busca marco",
            "SELECT DISTINCT Nom_promo, upper(trim(Nom_promo)) AS mayus, lower(Nom_promo) AS minus, "
            "substr(Nom_promo, 1, 3) AS inicio, CAST(length(Nom_promo) AS INT) AS largo, "
            "replace(Nom_promo, '#', '-') AS cambio, split_part(Nom_promo, ' ', 1) AS palabra, "
            "starts_with(Nom_promo, '2x') AS es_2x, Nom_promo LIKE '%off%' AS es_off, "
            "regexp_matches(lower(Nom_promo), 'brand#1[0-9]$') AS busca, "
            "'[' || Nom_promo || ']' AS marco FROM ventas WHERE Nom_promo IS NOT NULL"),
        "x05_math": sql(
            "Categoria div_cero r0 r1 r2 r3 par piso",
            "SELECT Categoria, CAST(NULL AS DOUBLE) AS div_cero, ROUND(Mg_pct * 100, 0) AS r0, "
            "ROUND(Mg_pct * 100, 1) AS r1, ROUND(Mg_pct * 100, 2) AS r2, ROUND(Mg_pct, 3) AS r3, "
            "round_even(Mg_pct * 100, 1) AS par, greatest(Mg_pct - 0.2, 0.01) AS piso "
            "FROM r_cat_promo_cross"),
        "x06_conditional": sql(
            "Clase Ingresos Unidades",
            "SELECT CASE WHEN has_promo = 1 THEN 'con promo' WHEN Categoria IS NULL THEN 'sin categoria' "
            "ELSE COALESCE(NULLIF(Nom_prod, ''), 'sin nombre') END AS Clase, SUM(Importe) AS Ingresos, "
            "SUM(Cantidad) AS Unidades FROM promo_prod GROUP BY 1"),
        "x07_dates": sql(
            "Fecha Semana nro mes_sig",
            f"SELECT DISTINCT Fecha, {_week('Fecha')} AS Semana, "
            "CAST(week(CAST(Fecha AS DATE)) AS INT) AS nro, "
            "strftime(date_trunc('month', CAST(Fecha AS DATE)) + INTERVAL 1 MONTH, '%Y-%m') AS mes_sig "
            "FROM lineas"),
        "x08_code_cycle": sql(
            "Cod_promo Ciclo",
            "SELECT DISTINCT Cod_promo, COALESCE(array_to_string(string_split(Cod_promo, '-')[1:2], '-'), '') "
            "AS Ciclo FROM ventas"),
        "m01_sales_measures": sql(
            "Anio_mes " + _M01, agg("ventas", "month", _M01)),
        "m02_flag_measures": sql("Categoria " + _M02, agg("promo_prod", "Categoria", _M02)),
        # reports under a filter
        "q05_evol_v_filtered": sql(
            REPORT_COLUMNS["evol_v"],
            agg("ventas", "month", "Ingresos Margen Mg_pct Descuento", _ATTRIBUTES)),
        "q07_prod_mg_filtered": sql(
            REPORT_COLUMNS["prod_mg"], REPORT_SQL["prod_mg"].replace("FROM productos", "FROM p08"),
            **_F08_CTES),
        "q19_ticket_promo_mes_filtered": sql(
            REPORT_COLUMNS["ticket_promo_mes"],
            REPORT_SQL["ticket_promo_mes"].replace("FROM ventas", "FROM v09")
            .replace("FROM tickets", "FROM t09"), **_F09_CTES),
        "q28_penetracion_cat_filtered": sql(
            REPORT_COLUMNS["penetracion_cat"],
            REPORT_SQL["penetracion_cat"].replace("FROM promo_prod", "FROM pp10"), **_F10_CTES),
    }
    # Raw text and re-read numbers keep their column names but not the usual output types.
    texts = {"c1": "Cantidad", "c2": "Precio", "c3": "Importe", "c4": "Costo_unit"}
    for key, names in {"s01_sales_csv_scan": texts, "s01_quoted_line_breaks": texts,
                       "n04_numeric_text": {"c4": "Costo_unit"},
                       "s07_export_summary_csv": {"n1": "Ingresos", "n2": "Unidades", "n3": "Costo",
                                                  "n4": "Margen", "n5": "Margen_pct"}}.items():
        renames = ", ".join(f"{a} AS {b}" for a, b in names.items())
        out[key] = f"SELECT * EXCLUDE ({', '.join(names)}), {renames} FROM ({out[key]})"
    for i, name in enumerate(("ventas", "productos", "promo_prod", "ventas_dia"), 1):
        source = "ventas_dia" if name == "ventas_dia" else "lineas"
        out[f"a0{i}_{name}"] = sql(f"{' '.join(_ROLLUP_KEYS[name])} {_OUT4}", _rollup(name, source))
    return out


_M01 = (
    "Ingresos Unidades Costo Ing_lista Margen Descuento Mg_pct Desc_pct ROI Markup Precio_ef "
    "Precio_lista Costo_unit Mix_promo Ing_con_codigo Ing_sin_codigo Und_con_codigo Und_sin_codigo "
    "Ing_codigo_no_vacio N_tiendas N_promos"
)
_M02 = (
    "Cant_promo Cant_sin_promo Ing_promo Ing_sin_promo Costo_promo Costo_sin_promo Penetracion "
    "Penetracion_ing Primer_mes Ultimo_mes Meses"
)
