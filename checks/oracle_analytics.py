"""SQL for the drill-down and the analytics that follow the reports."""

from __future__ import annotations

from checks.oracle import REPORT_COLUMNS, _over, _rounded, agg, sql, statement
# The months of the test tables' orders after the shift of 28 years.
MONTHS = [f"{y}-{m:02d}" for y in range(2023, 2030) for m in range(1, 13)][:80]

_DRILL = "COALESCE(NULLIF(trim(Nom_promo), ''), Cod_promo, '?') = 'Combo Brand#13'"


def _top(body: str, order: str, n: int) -> str:
    return f"SELECT * FROM ({body}) ORDER BY {order} LIMIT {n}"


def _band(value: str, steps: list[tuple[str, str]], rest: str) -> str:
    cases = " ".join(f"WHEN {value} {test} THEN '{label}'" for test, label in steps)
    return f"CASE {cases} ELSE '{rest}' END"


_MARGIN_ALERT = [("< 0", "Negativo"), ("< 0.05", "Bajo <5%"), ("< 0.35", "Normal")]
_TIES = "Producto, Codigo NULLS LAST, Categoria"

_COVERAGE = f"""
    SELECT *, CASE WHEN Mg_pct >= 0.2 AND ROI >= 2 AND Cobertura >= 0.3 THEN 'Buena'
                   WHEN Mg_pct >= 0.1 OR COALESCE(ROI, 0) >= 1 THEN 'Regular'
                   ELSE 'Crítica' END AS Semaforo
    FROM (SELECT *, COALESCE({_over('Tiendas', '(SELECT tiendas FROM r_kpis_t)')}, 0) AS Cobertura
          FROM r_promos)"""

_STORE_RANK = f"""
    SELECT * EXCLUDE (Tickets, Tkt_promo), Tickets, Tkt_promo,
           {_over('Ingresos', 'Tickets')} AS Ticket_prom
    FROM r_tiendas_v LEFT JOIN r_tiendas_t USING (Tiendas) ORDER BY Ingresos DESC, Tiendas LIMIT 15"""

_FATIGUE = f"""
    WITH m AS (SELECT COALESCE(NULLIF(trim(Nom_promo), ''), Cod_promo, '?') AS Promo, Anio_mes,
                      SUM(Importe) AS Ingresos, bool_or(Cod_promo IS NOT NULL) AS codigo
               FROM ventas GROUP BY 1, 2),
    l AS (SELECT Promo, list(Anio_mes ORDER BY Anio_mes) AS ms, list(Ingresos ORDER BY Anio_mes) AS v,
                 bool_or(codigo) AS codigo FROM m GROUP BY 1)
    SELECT Promo, ms[-1] AS Ultimo_mes, len(ms) AS Meses, v[-1] AS Ing_ultimo, v[-3] AS Ing_base,
           {_over('v[-1]', 'v[-3]')} - 1 AS Variacion,
           CASE WHEN CAST(v[-1] AS DOUBLE) < CAST(v[-3] AS DOUBLE) * 0.75 THEN 'Fatiga'
                WHEN CAST(v[-1] AS DOUBLE) > CAST(v[-3] AS DOUBLE) * 1.2 THEN 'Crecimiento'
                ELSE 'Estable' END AS Estado
    FROM l WHERE len(ms) >= 3 AND codigo"""

_ZONES = """
    SELECT *, CASE WHEN Desc_pct > 0.2 THEN CASE WHEN Mg_pct < 0.15
                       THEN 'Peligro: desc. alto + margen bajo' ELSE 'Alto margen con descuento alto' END
                   WHEN Mg_pct >= 0.15 THEN 'Ideal: desc. bajo + margen alto'
                   ELSE 'Sin descuento significativo' END AS Zona
    FROM r_desc_mg_prod WHERE Desc_pct BETWEEN 0 AND 1 AND Mg_pct BETWEEN -0.5 AND 1"""

_HALVES = """
    SELECT Categoria, AVG(Mg_pct) FILTER (pos <= n // 2) AS Mg_inicio,
           AVG(Mg_pct) FILTER (pos > n // 2) AS Mg_fin
    FROM r_mg_cat_mes JOIN (SELECT Anio_mes, row_number() OVER (ORDER BY Anio_mes) AS pos,
                                   COUNT(*) OVER () AS n
                            FROM (SELECT DISTINCT Anio_mes FROM r_mg_cat_mes)) USING (Anio_mes)
    WHERE n >= 2 GROUP BY 1"""

_PACKED = """
    SELECT s.*, COALESCE(Formato_promo, '–') AS Formato_promo,
           COALESCE(Unidades_por_promo, 1) AS Unidades_por_promo,
           CAST(round_even(CAST(Unidades AS DOUBLE) / COALESCE(Unidades_por_promo, 1), 0) AS BIGINT)
               AS Transacciones
    FROM r_sku_por_promo s LEFT JOIN catalogo c ON s.Cod_promo = c.Cod_promo"""
_SKU = REPORT_COLUMNS["sku_por_promo"]


def _ranking(order: str, n: int, where: str = "TRUE") -> str:
    return f"""
        SELECT *, COALESCE({_over('Unidades', 'SUM(Unidades) OVER ()')}, 0) AS Penetracion,
               COALESCE({_over('Transacciones', 'SUM(Transacciones) OVER ()')}, 0) AS Participacion
        FROM ({_PACKED}) WHERE {where}
        ORDER BY {order} DESC, Ingresos DESC, Promo, Cod_promo, Categoria LIMIT {n}"""


_RANK_OUT = _SKU + " Formato_promo Unidades_por_promo Transacciones Penetracion Participacion"

_CATALOG = """
    SELECT s.*, COALESCE(Formato_promo, 'Sin catalogo') AS Formato_promo,
           COALESCE(Unidades_por_promo, 1) AS Unidades_por_promo,
           CAST(round_even(CAST(Unidades AS DOUBLE) / COALESCE(Unidades_por_promo, 1), 0) AS BIGINT)
               AS Transacciones_promo
    FROM r_sku_por_promo s LEFT JOIN catalogo c ON upper(trim(s.Cod_promo)) = c.Cod_promo"""
_CATALOG_OUT = _SKU + " Formato_promo Unidades_por_promo Transacciones_promo"
_UNSOLD = """
    SELECT Cod_promo AS Codigo, Nom_promo AS Nombre, Formato_promo AS Formato,
           Unidades_por_promo AS Pack, regexp_extract(Cod_promo, '^[^-]*-[^-]*') AS Ciclo
    FROM catalogo WHERE Cod_promo NOT IN (SELECT Cod_promo FROM r_sku_por_promo)"""


def _matrix(source: str, row: str, value: str, empty: str, extra: str = "") -> str:
    months = ", ".join(
        f"COALESCE(SUM(CASE WHEN Anio_mes = '{m}' THEN {value} END), {empty}) AS \"{m}\""
        for m in MONTHS)
    return f"SELECT {row}, {months}{extra} FROM {source} GROUP BY {row}"


def _month_columns(row: str, digits: int) -> str:
    def value(month: str) -> str:
        return f"ROUND(CAST({month} AS DOUBLE), 4)" if digits == 4 else _rounded(month)

    return f"{row}, " + ", ".join(f'{value(chr(34) + m + chr(34))} AS "{m}"' for m in MONTHS)


def _series(period: str, value: str, source: str, where: str = "TRUE", split: str = "") -> str:
    keys = f"{period} AS Periodo" + (f", {split}" if split else "")
    return f"SELECT {keys}, {value} AS Valor FROM {source} WHERE {where} GROUP BY ALL"


_TOTALS = "Ingresos Margen Unidades"


def _yoy() -> str:
    years = "SELECT Anio, SUM(Ingresos) AS Ingresos, SUM(Margen) AS Margen, SUM(Unidades) AS Unidades " \
            "FROM r_yoy_mes GROUP BY 1"
    changes = ", ".join(f"COALESCE({_over('a.' + c, 'b.' + c)} - 1, 0) AS Var_{c}, "
                        f"b.{c} AS {c}_prev" for c in _TOTALS.split())
    return f"""SELECT a.*, b.Anio AS Anio_prev, {changes} FROM ({years}) a, ({years}) b
               WHERE a.Anio = (SELECT MAX(Anio) FROM r_yoy_mes)
                 AND b.Anio = (SELECT MAX(Anio) FROM r_yoy_mes WHERE Anio < a.Anio)"""


_YOY_YEARS = "(SELECT DISTINCT Anio FROM r_yoy_mes ORDER BY Anio DESC LIMIT 1 OFFSET {})"
_SKU_OUT = REPORT_COLUMNS["sku_ranking"]


def _with_months(body: str, row: str, digits: int, extra: str = "") -> str:
    """A matrix statement with typed month columns."""
    return statement(_month_columns(row, digits) + extra, body)


def analytics() -> dict[str, str]:
    prod = REPORT_COLUMNS["prod_mg"]
    cmp_out = REPORT_COLUMNS["compresion"]
    al = REPORT_COLUMNS["alertas"]
    alp = REPORT_COLUMNS["alertas_promo"]
    pen = REPORT_COLUMNS["penetracion_prod"]
    half = ("CASE WHEN Delta > 0.01 THEN 'Mejorando' WHEN Delta < -0.01 THEN 'Deteriorando' "
            "ELSE 'Estable' END AS Tendencia")
    margins = (f"{_over('Ing_promo - Costo_promo', 'Ing_promo')} AS Mg_promo, "
               f"{_over('Ing_sin_promo - Costo_sin_promo', 'Ing_sin_promo')} AS Mg_sin_promo")
    alert = {
        "neg": "Mg_pct < 0", "low": "Mg_pct >= 0 AND Mg_pct < 0.05 AND Ingresos > 50000",
        "desc": "Desc_pct > CAST(0.3 AS DOUBLE)", "cost": "Precio_ef < Costo_unit",
        "roi": "ROI < 1", "exc": "Desc_pct > CAST(0.4 AS DOUBLE)",
    }

    def picked(condition: str, n: int) -> str:
        return _top(f"SELECT * FROM r_compresion WHERE {condition}",
                    "Delta_mg, Producto, Categoria", n)

    return {
        "q40_promo_drill_months": sql(
            "Promo Anio_mes Ingresos Unidades Tiendas Mg_pct ROI",
            "SELECT 'Combo Brand#13' AS Promo, * FROM (" + agg(
                "ventas", "month", "Ingresos Unidades Tiendas=N_tiendas Mg_pct ROI",
                f"{_DRILL} AND left(Anio_mes, 4) IN ('2024', '2025') AND Tipo IN ('A', 'N')") + ")"),
        "q41_promo_drill_stores": sql(
            "Tiendas Ingresos Mg_pct",
            agg("ventas", "store", "Ingresos Mg_pct", _DRILL, order="Ingresos DESC", limit=20)),
        "p01_header_kpis": sql(
            "ing und costo margen mg_pct markup tickets tiendas ticket_prom mix_promo desc_pct "
            "desc_total n_promos",
            f"SELECT v.*, {_over('ing - costo', 'ing')} AS markup, tkt AS tickets, tiendas, "
            f"{_over('ing', 'tkt')} AS ticket_prom, {_over('ing_promo', 'ing')} AS mix_promo "
            "FROM r_kpis_v v, r_kpis_t"),
        "p01_header_period": sql(
            "Meses Primer_mes Ultimo_mes",
            "SELECT COUNT(DISTINCT Anio_mes) AS Meses, MIN(Anio_mes) AS Primer_mes, "
            "MAX(Anio_mes) AS Ultimo_mes FROM ventas WHERE left(Anio_mes, 4) IN ('2024', '2025') "
            "AND Anio_mes IN (SELECT Anio_mes FROM meses_ciclo WHERE ciclo IN ('C2', 'C3'))"),
        "p02_monthly_evolution": sql(
            REPORT_COLUMNS["evol_v"] + " Tickets",
            "SELECT * FROM r_evol_v LEFT JOIN r_evol_t USING (Anio_mes)"),
        "p03_category_health": sql(
            "Categoria Ingresos Margen Mg_pct Pct_total Estado",
            f"SELECT *, {_over('Ingresos', 'SUM(Ingresos) OVER ()')} AS Pct_total, "
            + _band("Mg_pct", [(">= 0.2", "Saludable"), (">= 0.1", "Ajustado")], "Crítico")
            + " AS Estado FROM r_treemap"),
        "p04_top_margin": sql(prod, _top(
            "SELECT * FROM r_prod_mg", f"Mg_pct DESC NULLS LAST, Ingresos DESC, {_TIES}", 15)),
        "p04_bottom_margin": sql(prod, _top(
            "SELECT * FROM r_prod_mg WHERE Ingresos > 1000",
            f"Mg_pct NULLS LAST, Ingresos DESC, {_TIES}", 15)),
        "p05_portfolio": sql(
            "Producto Codigo Categoria Unidades Mg_pct Ingresos Margen Tamano Mediana_und Mediana_mg "
            "Cuadrante",
            "SELECT *, greatest(Ingresos, 0.01) AS Tamano, "
            "CASE WHEN Mg_pct >= Mediana_mg THEN 'Alto' ELSE 'Bajo' END || ' margen · ' || "
            "CASE WHEN Unidades >= Mediana_und THEN 'alta' ELSE 'baja' END || ' rotación' AS Cuadrante "
            "FROM r_prod_mg, (SELECT median(CAST(Unidades AS DOUBLE)) AS Mediana_und, "
            "median(Mg_pct) AS Mediana_mg FROM r_prod_mg WHERE Ingresos > 0) WHERE Ingresos > 0"),
        "p06_margin_composition": sql(
            "Categoria Producto Codigo Margen Mg_pct Ingresos",
            "SELECT * FROM r_prod_mg WHERE Margen > 0"),
        "p07_product_list": sql(
            prod + " Nro Estado",
            "SELECT *, " + _band("Mg_pct", [("< 0", "NEG"), ("< 0.1", "LOW")], "OK") + " AS Estado, "
            f"row_number() OVER (ORDER BY Ingresos DESC, {_TIES}) AS Nro FROM r_prod_mg "
            f"ORDER BY Ingresos DESC, {_TIES} LIMIT 45"),
        **{
            key: sql(
                "Anio_mes Precio_lista Precio_ef Costo_unit Mg_pct Unidades",
                "SELECT Anio_mes, AVG(Precio_lista) AS Precio_lista, AVG(Precio_ef) AS Precio_ef, "
                "AVG(Costo_unit) AS Costo_unit, AVG(Mg_pct) AS Mg_pct, SUM(Unidades) AS Unidades "
                f"FROM r_precio_evol WHERE {where} GROUP BY 1")
            for key, where in (("p08_price_evolution", "TRUE"),
                               ("p08_price_evolution_one", "Categoria = 'Brand#11'"))
        },
        "p09_compressed": sql(cmp_out, picked("Delta_mg < -0.01", 15)),
        "p09_expanded": sql(cmp_out, picked("Delta_mg > 0.01", 15)),
        "p10_raise_price": sql(cmp_out, picked("Delta_mg < -0.02", 15)),
        "p10_lower_price": sql(cmp_out, picked("Mg_fin_pct > 35 AND Delta_mg > 0", 15)),
        "p11_promo_coverage": sql(REPORT_COLUMNS["promos"] + " Cobertura Semaforo", _COVERAGE),
        "p12_promo_totals": sql(
            "Ing_promo Margen_promo Inversion Buenas Regulares Criticas ROI_global",
            "SELECT SUM(Ingresos) AS Ing_promo, SUM(Margen) AS Margen_promo, SUM(Descuento) AS Inversion, "
            "COUNT(*) FILTER (Semaforo = 'Buena') AS Buenas, "
            "COUNT(*) FILTER (Semaforo = 'Regular') AS Regulares, "
            "COUNT(*) FILTER (Semaforo = 'Crítica') AS Criticas, "
            f"CASE WHEN SUM(Descuento) > 0 THEN {_over('SUM(Ingresos)', 'SUM(Descuento)')} ELSE 0 END "
            f"AS ROI_global FROM ({_COVERAGE})"),
        "p13_promo_month_matrix": _with_months(
            _matrix("r_heatmap_promo", "Promo", "Ingresos", "0"), "Promo", 4),
        "p14_promo_fatigue": sql(
            "Promo Ultimo_mes Meses Ing_ultimo Ing_base Variacion Estado", _FATIGUE),
        "p15_store_ranking": sql(
            REPORT_COLUMNS["tiendas_v"] + " Tickets Tkt_promo Ticket_prom", _STORE_RANK),
        "p16_store_means": sql(
            "n Media_ing Mg_pct Mix_promo",
            f"SELECT COUNT(*) AS n, {_rounded('AVG(CAST(Ingresos AS DOUBLE))')} AS Media_ing, "
            f"AVG(Mg_pct) AS Mg_pct, AVG(Mix_promo) AS Mix_promo FROM ({_STORE_RANK})")
        .replace("SELECT n, Media_ing", "SELECT n AS Tiendas, Media_ing AS Ingresos", 1),
        "p16_store_scatter": sql(
            REPORT_COLUMNS["tiendas_v"] + " Tickets Tkt_promo Ticket_prom",
            f"SELECT * FROM ({_STORE_RANK}) WHERE Precio_ef IS NOT NULL AND Ticket_prom IS NOT NULL"),
        "p17_category_coverage": sql(
            REPORT_COLUMNS["cobertura_prod"] + " Cobertura_pct",
            f"SELECT *, {_over('N_tiendas', '(SELECT MAX(N_tiendas) FROM r_cobertura_prod)')} "
            "AS Cobertura_pct FROM r_cobertura_prod"),
        "p18_negative_margin": sql(al, f"SELECT * FROM r_alertas WHERE {alert['neg']}"),
        "p19_low_margin": sql(al, f"SELECT * FROM r_alertas WHERE {alert['low']}"),
        "p20_high_discount": sql(al, f"SELECT * FROM r_alertas WHERE {alert['desc']}"),
        "p21_below_cost": sql(
            al + " Gap",
            f"SELECT *, Precio_ef - Costo_unit AS Gap FROM r_alertas WHERE {alert['cost']}"),
        "p22_low_roi": sql(alp, f"SELECT * FROM r_alertas_promo WHERE {alert['roi']}"),
        "p23_excessive_discount": sql(alp, f"SELECT * FROM r_alertas_promo WHERE {alert['exc']}"),
        "p24_alert_counts": sql(
            "Margen_negativo Margen_bajo Descuento_alto Bajo_costo ROI_bajo Descuento_excesivo",
            "SELECT * FROM (SELECT "
            f"COUNT(*) FILTER ({alert['neg']}) AS Margen_negativo, "
            f"COUNT(*) FILTER ({alert['low']}) AS Margen_bajo, "
            f"COUNT(*) FILTER ({alert['desc']}) AS Descuento_alto, "
            f"COUNT(*) FILTER ({alert['cost']}) AS Bajo_costo FROM r_alertas), (SELECT "
            f"COUNT(*) FILTER ({alert['roi']}) AS ROI_bajo, "
            f"COUNT(*) FILTER ({alert['exc']}) AS Descuento_excesivo FROM r_alertas_promo)"),
        "p25_margin_band_top": sql(al + " Estado", _top(
            "SELECT *, " + _band("Mg_pct", _MARGIN_ALERT, "Alto")
            + " AS Estado FROM r_alertas WHERE Mg_pct BETWEEN -2 AND 2",
            "Ingresos DESC, Producto, Categoria", 20)),
        "p26_category_alerts": sql(
            "Categoria Ingresos Productos Neg Bajo Mg_pct_w Estado",
            "SELECT *, " + _band("Mg_pct_w", _MARGIN_ALERT, "Alto") + " AS Estado FROM ("
            "SELECT Categoria, SUM(Ingresos) AS Ingresos, COUNT(*) AS Productos, "
            "COUNT(*) FILTER (Mg_pct < 0) AS Neg, "
            "COUNT(*) FILTER (Mg_pct >= 0 AND Mg_pct < 0.05) AS Bajo, "
            f"CASE WHEN SUM(Ingresos) > 0 THEN {_over('SUM(Margen)', 'SUM(Ingresos)')} ELSE 0 END "
            "AS Mg_pct_w FROM r_alertas GROUP BY 1)"),
        "p27_margin_matrix": _with_months(
            "SELECT * FROM (" + _matrix("r_mg_cat_mes", "Categoria", "Mg_pct", "NULL",
                                        ", AVG(Mg_pct) AS Media") + ") WHERE Media IS NOT NULL",
            "Categoria", 6, f", {_rounded('Media')} AS Media"),
        "p28_margin_trend": sql(
            "Categoria Mg_inicio Mg_fin Delta Tendencia",
            f"SELECT *, {half} FROM (SELECT *, Mg_fin - Mg_inicio AS Delta FROM ({_HALVES}) "
            "WHERE Mg_inicio IS NOT NULL AND Mg_fin IS NOT NULL)"),
        "p29_margin_volatility": sql(
            "Categoria Media StdDev Meses",
            _top("SELECT Categoria, AVG(Mg_pct) AS Media, stddev_samp(Mg_pct) AS StdDev, "
                 "COUNT(Mg_pct) AS Meses FROM r_mg_cat_mes GROUP BY 1 HAVING COUNT(Mg_pct) > 1",
                 "StdDev DESC, Categoria", 15)),
        "p30_discount_zones": sql(REPORT_COLUMNS["desc_mg_prod"] + " Zona", _ZONES),
        "p30_zone_counts": sql(
            "Zona Productos", f"SELECT Zona, COUNT(*) AS Productos FROM ({_ZONES}) GROUP BY 1"),
        "p31_danger_zone": sql(REPORT_COLUMNS["desc_mg_prod"] + " Zona", _top(
            f"SELECT * FROM ({_ZONES}) WHERE starts_with(Zona, 'Peligro')",
            "Ingresos DESC, Producto, Categoria", 15)),
        "p32_promo_intensity": sql(
            REPORT_COLUMNS["cat_promo_cross"] + " Mediana_mix Mediana_mg Estado",
            "SELECT *, (SELECT median(Mix_promo) FROM r_cat_promo_cross) AS Mediana_mix, "
            "(SELECT median(Mg_pct) FROM r_cat_promo_cross) AS Mediana_mg, "
            + _band("Mg_pct", [(">= 0.2", "OK"), (">= 0.1", "MED")], "LOW")
            + " AS Estado FROM r_cat_promo_cross"),
        **{
            key: sql(
                "Anio_mes Precio_lista Precio_ef Gap_pct",
                "SELECT Anio_mes, AVG(Precio_lista) AS Precio_lista, AVG(Precio_ef) AS Precio_ef, "
                f"AVG(Gap_pct) AS Gap_pct FROM r_precio_gap WHERE {where} GROUP BY 1")
            for key, where in (("p33_price_gap_by_month", "TRUE"),
                               ("p33_price_gap_one_category", "Categoria = 'Sin cat.'"))
        },
        "p34_price_gap_by_category": sql(
            "Categoria Gap_pct Precio_lista Precio_ef Ingresos",
            "SELECT Categoria, AVG(Gap_pct) AS Gap_pct, AVG(Precio_lista) AS Precio_lista, "
            "AVG(Precio_ef) AS Precio_ef, SUM(Ingresos) AS Ingresos FROM r_precio_gap GROUP BY 1"),
        "p35_price_volume_correlation": sql(
            "Categoria Correlacion Precio_prom Unidades_prom Ingresos_tot Tipo",
            "SELECT *, CASE WHEN Correlacion < -0.3 THEN 'Elástica (precio↑ → vol↓)' "
            "WHEN Correlacion > 0.3 THEN 'Inelástica (precio no afecta vol)' "
            "ELSE 'Sin correlación clara' END AS Tipo FROM ("
            "SELECT Categoria, corr(Precio_ef, CAST(Unidades AS DOUBLE)) AS Correlacion, "
            "AVG(Precio_ef) AS Precio_prom, AVG(CAST(Unidades AS DOUBLE)) AS Unidades_prom, "
            "SUM(Ingresos) AS Ingresos_tot FROM r_precio_evol GROUP BY 1 HAVING COUNT(*) >= 3 "
            "AND stddev_samp(Precio_ef) > 0 AND stddev_samp(CAST(Unidades AS DOUBLE)) > 0)"),
        "p36_penetration_totals": sql(
            "Cant_total Cant_promo Cant_sin_promo Ingresos Ing_promo Productos Pen_unidades Pen_ingresos",
            "SELECT SUM(Cant_total) AS Cant_total, SUM(Cant_promo) AS Cant_promo, "
            "SUM(Cant_sin_promo) AS Cant_sin_promo, SUM(Ingresos) AS Ingresos, "
            "SUM(Ing_promo) AS Ing_promo, COUNT(*) AS Productos, "
            f"{_over('SUM(Cant_promo)', 'SUM(Cant_total)')} AS Pen_unidades, "
            f"{_over('SUM(Ing_promo)', 'SUM(Ingresos)')} AS Pen_ingresos FROM r_penetracion_prod"),
        "p37_penetration_by_month": sql(
            REPORT_COLUMNS["penetracion_mes"] + " CicloAno",
            "SELECT *, COALESCE(CicloAno_mes, '') AS CicloAno FROM r_penetracion_mes "
            "LEFT JOIN meses_ciclo USING (Anio_mes)"),
        "p38_penetration_matrix": _with_months(
            _matrix("r_penetracion_cat_mes", "Categoria", "Penetracion", "0",
                    ", SUM(Penetracion) / (SELECT COUNT(DISTINCT Anio_mes) "
                    "FROM r_penetracion_cat_mes) AS Media"),
            "Categoria", 6, f", {_rounded('Media')} AS Media"),
        "p39_penetrated_products": sql(
            pen + " Mg_promo Mg_sin_promo",
            f"SELECT *, {margins} FROM (" + _top(
                "SELECT * FROM r_penetracion_prod WHERE Penetracion >= CAST(0.2 AS DOUBLE)",
                "Ingresos DESC, Producto, Categoria", 15) + ")"),
        "p39_penetrated_products_one": sql(
            pen + " Mg_promo Mg_sin_promo",
            f"SELECT * FROM (SELECT *, {margins} FROM (" + _top(
                "SELECT * FROM r_penetracion_prod WHERE Penetracion >= 0.5 "
                "AND Categoria = 'Brand#12'", "Ingresos DESC, Producto, Categoria", 15)
            + ")) WHERE Mg_promo IS NOT NULL AND Mg_sin_promo IS NOT NULL"),
        "p40_penetration_table": sql(
            pen + " Alerta",
            "SELECT *, " + _band("Penetracion", [("> 0.7", "Muy alta"), ("> 0.4", "Alta"),
                                                 ("> 0.1", "Normal")], "Sin promo")
            + " AS Alerta FROM r_penetracion_prod"),
        "p41_price_ladder": sql(
            REPORT_COLUMNS["price_ladder"] + " Gap_lista",
            f"SELECT *, round_even({_over('Precio_lista - Precio_ef', 'Precio_lista')} * 100, 1) "
            "AS Gap_lista FROM r_price_ladder WHERE Precio_ef IS NOT NULL"),
        "p42_promo_kpis": sql(
            "Ing_promo Und_promo Filas_promo f Und_total Und_sin_promo Penetracion",
            "SELECT *, Und_total - Und_promo AS Und_sin_promo, "
            f"{_over('Und_promo', 'Und_total')} AS Penetracion FROM (SELECT SUM(Ingresos) AS Ing_promo, "
            "SUM(Unidades) AS Und_promo, COUNT(*) AS Filas_promo, "
            f"{_rounded('SUM(CAST(Unidades AS DOUBLE) / Unidades_por_promo)')} AS f, "
            "(SELECT SUM(Unidades_total) FROM r_pen_cat_v) AS Und_total "
            f"FROM ({_PACKED}))").replace(" f, ", " f AS Transacciones, ", 1),
        "p43_promo_ranking": sql(_RANK_OUT, _ranking("Transacciones", 20)),
        "p43_promo_ranking_by_revenue": sql(
            _RANK_OUT, _ranking("Ingresos", 30, "Categoria = 'Brand#13'")),
        "p43_promo_ranking_search": sql(
            _RANK_OUT, _ranking("Participacion", 20, "Promo ILIKE '%combo%'")),
        "p44_category_penetration": sql(
            REPORT_COLUMNS["pen_cat_v"] + " Penetracion Pct_sin",
            "SELECT *, 1 - COALESCE(Penetracion, 0) AS Pct_sin FROM (SELECT *, "
            f"{_over('Unidades_promo', 'Unidades_total')} AS Penetracion FROM r_pen_cat_v) "
            "ORDER BY Penetracion DESC NULLS LAST, Categoria LIMIT 20"),
        "p45_modality_units": sql(
            "Modalidad Unidades",
            "SELECT Modalidad, SUM(Unidades) AS Unidades FROM r_modalidad_venta GROUP BY 1"),
        "p45_modality_revenue_one": sql(
            "Modalidad Ingresos",
            "SELECT Modalidad, SUM(Ingresos) AS Ingresos FROM r_modalidad_venta "
            "WHERE Categoria = 'Brand#14' GROUP BY 1"),
        "p46_daily_revenue": sql("Periodo Valor", _series("Fecha", "SUM(Importe)", "ventas_dia")),
        "p46_weekly_units_by_category": sql("Periodo Categoria Valor", _series(
            "Semana", "SUM(Cantidad)", "ventas_dia", "Categoria IS NOT NULL", "Categoria")),
        "p46_daily_promos": _int_value(sql("Periodo v", _series(
            "Fecha", "COUNT(DISTINCT Nom_promo)", "ventas_dia").replace("AS Valor", "AS v"))),
        "p47_monthly_revenue_by_promo": sql("Periodo Promo Valor", _series(
            "Anio_mes", "SUM(Importe)", "ventas_dia", "Nom_promo IS NOT NULL", "Nom_promo AS Promo")),
        "p47_monthly_promos_by_category": _int_value(sql("Periodo Categoria v", _series(
            "Anio_mes", "COUNT(DISTINCT Nom_promo)", "ventas_dia", "Categoria IS NOT NULL",
            "Categoria").replace("AS Valor", "AS v"))),
        "p48_cycle_revenue": sql("Periodo Valor", _series("Ciclo", "SUM(Ingresos)", "r_evo_ciclo")),
        "p48_cycle_promos_by_category": _int_value(sql("Periodo Categoria v", _series(
            "Ciclo", "COUNT(DISTINCT Promo)", "r_evo_ciclo", split="Categoria")
            .replace("AS Valor", "AS v"))),
        "p48_cycle_units_by_promo": sql("Periodo Promo Valor", _series(
            "Ciclo", "SUM(Unidades)", "r_evo_ciclo", "Promo ILIKE '%lleva%'", "Promo")),
        "p49_promo_lines": sql(
            "Ciclo Promo Ingresos",
            "SELECT Ciclo, Promo, SUM(Ingresos) AS Ingresos FROM r_evo_ciclo "
            "WHERE Promo ILIKE '%brand#2%' GROUP BY ALL"),
        "p50_ticket_uplift": sql(
            "Tkt_con_promo Tkt_sin_promo Tkt_global Uplift",
            f"SELECT *, {_over('Tkt_con_promo - Tkt_sin_promo', 'Tkt_sin_promo')} AS Uplift FROM (SELECT "
            f"{_over('SUM(Ing_promo)', 'SUM(Tkts_promo)')} AS Tkt_con_promo, "
            f"{_over('SUM(Ing_sin_promo)', 'SUM(Tkts_sin_promo)')} AS Tkt_sin_promo, "
            f"{_over('SUM(Ing_total)', 'SUM(Tkts_total)')} AS Tkt_global FROM r_ticket_promo_mes "
            "WHERE Tkt_con_promo IS NOT NULL AND Tkt_sin_promo IS NOT NULL)"),
        "p50_ticket_uplift_by_month": sql(
            "Anio_mes Tkt_con_promo Tkt_sin_promo Uplift",
            "SELECT *, (Tkt_con_promo - Tkt_sin_promo) / Tkt_sin_promo AS Uplift FROM r_ticket_promo_mes "
            "WHERE Tkt_con_promo IS NOT NULL AND Tkt_sin_promo <> 0"),
        "p51_catalog_transactions": sql(_CATALOG_OUT, _CATALOG),
        "p51_top_catalog_transactions": sql(_CATALOG_OUT, _top(
            _CATALOG, "Transacciones_promo DESC, Promo, Cod_promo, Categoria", 20)),
        "p52_unsold_promos": sql("Codigo Nombre Formato Pack Ciclo", _UNSOLD),
        "p53_catalog_coverage": sql(
            "Con_venta Transacciones Planificadas Sin_venta Cobertura Cobertura_catalogo",
            f"SELECT *, {_over('Con_venta', 'Planificadas')} AS Cobertura, "
            f"{_over('Planificadas - Sin_venta', 'Planificadas')} AS Cobertura_catalogo FROM (SELECT "
            "COUNT(DISTINCT Cod_promo) AS Con_venta, SUM(Transacciones_promo) AS Transacciones, "
            "(SELECT COUNT(*) FROM catalogo) AS Planificadas, "
            f"(SELECT COUNT(*) FROM ({_UNSOLD})) AS Sin_venta FROM ({_CATALOG}))"),
        "p54_yoy_totals": sql(
            "Anio Ingresos Margen Unidades Anio_prev Ingresos_prev Margen_prev Unidades_prev "
            "Var_Ingresos Var_Margen Var_Unidades", _yoy()),
        "p55_yoy_by_category": sql(
            "Categoria Ing_last Ing_prev Var_pct",
            f"SELECT *, {_over('Ing_last', 'Ing_prev')} - 1 AS Var_pct FROM (SELECT Categoria, "
            "COALESCE(a.Ingresos, 0) AS Ing_last, COALESCE(b.Ingresos, 0) AS Ing_prev FROM "
            f"(SELECT * FROM r_yoy_cat WHERE Anio = {_YOY_YEARS.format(0)}) a FULL JOIN "
            f"(SELECT * FROM r_yoy_cat WHERE Anio = {_YOY_YEARS.format(1)}) b USING (Categoria))"),
        "p56_sku_best": sql(_SKU_OUT, _top(
            "SELECT * FROM r_sku_ranking", "Ingresos DESC, Producto, Categoria", 30)),
        "p56_sku_best_discount": sql(_SKU_OUT, _top(
            "SELECT * FROM r_sku_ranking", "Desc_pct NULLS LAST, Producto, Categoria", 40)),
        "p56_sku_worst": sql(_SKU_OUT, _top(
            "SELECT * FROM r_sku_ranking", "Margen, Producto DESC, Categoria DESC", 30)),
        "p56_sku_lowest_margin": sql(_SKU_OUT, _top(
            "SELECT * FROM r_sku_ranking", "Mg_pct NULLS LAST, Producto, Categoria", 30)),
        "p57_sku_kpis": sql(
            "SKUs Ingresos Mg_pct Desc_pct",
            "SELECT COUNT(*) AS SKUs, SUM(Ingresos) AS Ingresos, AVG(Mg_pct) AS Mg_pct, "
            "AVG(Desc_pct) AS Desc_pct FROM r_sku_ranking"),
        "p58_sku_position": sql(
            _SKU_OUT + " Mediana_ing Mediana_mg Tamano",
            "SELECT *, median(CAST(Ingresos AS DOUBLE)) OVER () AS Mediana_ing, "
            "median(Mg_pct) OVER () AS Mediana_mg, greatest(Unidades, 0.01) AS Tamano FROM ("
            + _top("SELECT * FROM r_sku_ranking", "Ingresos DESC, Producto, Categoria", 100)
            + ") WHERE Mg_pct IS NOT NULL AND Ingresos IS NOT NULL"),
        "p59_sku_terciles": sql(
            _SKU_OUT + " Nro Semaforo",
            "SELECT *, row_number() OVER (ORDER BY Ingresos DESC, Producto, Categoria) AS Nro, "
            "CASE WHEN Mg_pct > hi THEN 'OK' WHEN Mg_pct > lo THEN 'MED' ELSE 'LOW' END AS Semaforo "
            "FROM r_sku_ranking, (SELECT quantile_cont(Mg_pct, 0.66) AS hi, "
            "quantile_cont(Mg_pct, 0.33) AS lo FROM r_sku_ranking)"),
        "p60_ranking_mix": sql(
            "Promo Cod_promo Categoria Ingresos Transacciones Mix_ingresos Mix_transacciones",
            f"SELECT *, {_over('Ingresos', 'SUM(Ingresos) OVER ()')} AS Mix_ingresos, "
            f"{_over('Transacciones', 'SUM(Transacciones) OVER ()')} AS Mix_transacciones "
            f"FROM ({_ranking('Transacciones', 20)})"),
    }


def _int_value(statement: str) -> str:
    return f"SELECT * EXCLUDE (v), v AS Valor FROM ({statement})"
