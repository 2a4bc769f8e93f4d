"""The SQL each query must agree with, for DuckDB over the same parquet tables.

Written apart from the Spark code: reports go straight from sales lines (no rollups), measures and
keys are spelled out again, and the later analytics are plain SQL over those.
"""

from __future__ import annotations

import re

# --- output types -----------------------------------------------------------------------------

_SUMS = set("""
    ing und costo margen ing_lista desc_total ing_promo Ingresos Unidades Costo Margen Descuento
    Inversion Ing_lista Ing_con_codigo Ing_sin_codigo Und_con_codigo Und_sin_codigo
    Ing_codigo_no_vacio Cant_promo Cant_sin_promo Cant_total Ing_promo Ing_sin_promo Ing_total
    Ing_promo_total Costo_promo Costo_sin_promo Unidades_total Unidades_promo Unidades_sin_promo
    Ingresos_total Ingresos_promo Importe Cantidad Precio_x_Cant Costo_total Precio Valor
    Ing_ultimo Ing_base Und_promo Und_total Und_sin_promo Ing_last Ing_prev Ingresos_prev
    Margen_prev Unidades_prev Margen_promo Tamano Ingresos_tot total
""".split())
_RATIOS = set("""
    mg_pct desc_pct markup ticket_prom mix_promo Mg_pct Desc_pct ROI Markup Precio_ef Precio_lista
    Costo_unit Mix_promo Gap_pct Penetracion Penetracion_ing Tkt_con_promo Tkt_sin_promo
    Tkt_promedio Tkt_con_promo_ref Mix_cat_promo Precio_inicio Precio_fin Costo_inicio Costo_fin
    Cambio_precio_pct Cambio_costo_pct Mg_inicio_pct Mg_fin_pct Delta_mg Margen_pct Pct_total
    Mediana_und Mediana_mg Mediana_mix Mediana_ing Cobertura ROI_global Variacion Pen_unidades
    Pen_ingresos Media Mg_promo Mg_sin_promo Pct_sin Transacciones_f Participacion Mix_ingresos
    Mix_transacciones Cobertura_catalogo Tkt_global Uplift Var_Ingresos Var_Margen Var_Unidades
    Var_pct Ticket_prom Cobertura_pct Gap Mg_pct_w Mg_inicio Mg_fin Delta StdDev Correlacion
    Precio_prom Unidades_prom Gap_lista div_cero r0 r1 r2 r3 par piso
""".split())
_COUNTS = set("""
    tkt tkt_p tickets tiendas n_promos N_promos N_tiendas Meses Tickets Tkt_promo Tkts_total
    Tkts_promo Tkts_sin_promo Promos n_meses Promos_distintas filas lineas meses Buenas Regulares
    Criticas Productos Neg Bajo Transacciones Transacciones_promo Filas_promo Con_venta
    Planificadas Sin_venta SKUs Nro Margen_negativo Margen_bajo Descuento_alto Bajo_costo ROI_bajo
    Descuento_excesivo n_tickets n_tkt_promo
""".split())


def _rounded(value: str) -> str:
    """Six places, halves away from zero.  Rounding a DECIMAL decides a tie by the decimal digits,
    as Spark does; rounding the DOUBLE would decide it by the binary error."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,9)), 6) AS DOUBLE)"


def _typed(column: str) -> str:
    name = column.strip('"')
    if name in _SUMS:
        return f"ROUND(CAST({column} AS DOUBLE), 4) AS {column}"
    if name in _RATIOS:
        return f"{_rounded(column)} AS {column}"
    if name in _COUNTS:
        return f"CAST({column} AS BIGINT) AS {column}"
    return column


# --- base tables ------------------------------------------------------------------------------

_DAY = "(o_orderdate + INTERVAL 336 MONTH)"
_CENTS = "CAST(round(l_discount * 100) AS INT)"
_NET = "l_extendedprice * (1 - (1 + 2 * (l_partkey % 5)) * l_discount)"
_TIPOS = "['CIRM', 'CIRG', 'CA', 'UM', 'CRM', 'CRG']"
_CODE = f"""CASE WHEN l_discount >= 0.045 THEN concat('C', (month(o_orderdate) + 1) // 2, '-',
    year(o_orderdate) + 28, '-', lpad(CAST({_CENTS} AS VARCHAR), 2, '0'), '-',
    {_TIPOS}[l_linenumber % 6 + 1]) END"""
_PROMO_NAME = f"""CASE {_CENTS} WHEN 5 THEN concat('2x ', p_brand) WHEN 6 THEN concat('Combo ', p_brand)
    WHEN 7 THEN concat('Lleva 3 ', p_brand) WHEN 8 THEN concat('20 % off ', p_brand)
    WHEN 9 THEN concat('CRM ', p_brand) WHEN 10 THEN '' END"""
_NAME = "CASE WHEN l_partkey % 97 = 0 THEN '' ELSE p_name END"
_CATEGORY = "CASE p_brand WHEN 'Brand#25' THEN 'SERVICIOS' WHEN 'Brand#24' THEN NULL ELSE p_brand END"
_JOIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_COST_CENTS = "(CAST(round(p_retailprice * 100) AS BIGINT) * (30 + l_partkey % 60) // 100)"
_STORE = "CAST(o_custkey % (SELECT COUNT(*) FROM supplier) AS VARCHAR)"

# The cycle calendar (cycle, year, first day, last day).
_CICLOS = [
    ("C5", "2023", "2023-09-06", "2023-11-02"),
    ("C6", "2023", "2023-11-03", "2024-01-02"),
    ("C1", "2024", "2024-01-03", "2024-03-05"),
    ("C2", "2024", "2024-03-06", "2024-05-07"),
    ("C3", "2024", "2024-05-08", "2024-07-02"),
    ("C4", "2024", "2024-07-03", "2024-09-03"),
    ("C5", "2024", "2024-09-04", "2024-11-05"),
    ("C6", "2024", "2024-11-06", "2025-01-07"),
    ("C1", "2025", "2025-01-08", "2025-03-04"),
    ("C2", "2025", "2025-03-05", "2025-05-06"),
    ("C3", "2025", "2025-05-07", "2025-07-01"),
    ("C4", "2025", "2025-07-02", "2025-09-02"),
    ("C5", "2025", "2025-09-03", "2025-11-04"),
    ("C6", "2025", "2025-11-05", "2026-01-06"),
    ("C1", "2026", "2026-01-07", "2026-03-03"),
    ("C2", "2026", "2026-03-04", "2026-05-05"),
    ("C3", "2026", "2026-05-06", "2026-06-30"),
    ("C4", "2026", "2026-07-01", "2026-09-01"),
    ("C5", "2026", "2026-09-02", "2026-11-03"),
    ("C6", "2026", "2026-11-04", "2027-01-05"),
]


def _ciclos() -> str:
    values = ", ".join(f"('{c}', '{y}', DATE '{a}', DATE '{z}')" for c, y, a, z in _CICLOS)
    return f"SELECT * FROM (VALUES {values}) AS v(ciclo, anio, ini, fin)"


# Categories outside the model, missing-value texts.
_EXCLUDED = ", ".join(f"'{c}'" for c in [
    "ACCESORIOS AUTOMOTRIZ", "COMBOS COMIDA", "COMBUSTIBLES OTROS", "COMISIONES",
    "CUPONES SC - DESCUENTOS", "DONACIONES", "Descuento MiCopiloto", "IMPRESOS", "LUBRICANTES",
    "PROMOCIONES COMBUSTIBLE", "PROMOCIONES TIENDA", "RINCON ENEX", "SERVICIO AUTOMOTRIZ",
    "SERVICIOS", "SIN CATEGORIA", "TARJETA BIP", "TELEFONIA MOVIL"])
_MISSING = ", ".join(f"'{c}'" for c in [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
_IN_MODEL = f"(Categoria IS NULL OR Categoria NOT IN ({_EXCLUDED}))"


def _week(day: str) -> str:
    return f"COALESCE(strftime(TRY_CAST({day} AS DATE), '%Y-W%V'), '')"


def _code_parts(code: str) -> str:
    parts = f"string_split(upper(trim({code})), '-')"

    def part(i: str) -> str:
        return f"COALESCE({parts}[{i}], '')"

    return f"""{part('1')} AS CicloNum_p,
        CASE WHEN {part('1')} <> '' AND {part('2')} <> '' THEN {part('1')} || '-' || {part('2')}
             ELSE '' END AS CicloAno_p,
        {part('2')} AS PromoAno, {part('3')} AS PromoNum,
        CASE WHEN len({parts}) >= 2 THEN {part('-1')} ELSE '' END AS TipoPromo"""


def _raw_text() -> str:
    fields = {
        "Tiendas": f"CASE WHEN l_suppkey % 41 = 0 THEN 'NA' ELSE concat(' ', {_STORE}, ' ') END",
        "Transaccion": "CAST(l_orderkey AS VARCHAR)",
        "Fecha_raw": f"CASE WHEN l_partkey % 89 = 0 THEN strftime({_DAY}, '%Y-%m') "
                     f"ELSE strftime({_DAY}, '%Y%m%d') END",
        "Cod_prod": "CAST(l_partkey AS VARCHAR)",
        "Nom_prod": _NAME,
        "Categoria": _CATEGORY,
        "Cantidad": "CASE l_linenumber % 5 WHEN 0 THEN concat(' ', CAST(l_quantity AS INT), ' ') "
                    "WHEN 1 THEN concat(CAST(l_quantity AS INT), '.0') "
                    "ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END",
        "Precio": "CASE WHEN l_partkey % 53 = 0 THEN '1,5' WHEN l_partkey % 71 = 0 THEN '123456789012.5' "
                  "ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END",
        "Importe": "CASE WHEN l_partkey % 59 = 0 THEN '1.5d' WHEN l_partkey % 61 = 0 THEN 'n/a' "
                   "WHEN l_partkey % 67 = 0 THEN '100000000000000' "
                   f"ELSE CAST(CAST({_NET} AS DECIMAL(18,4)) AS VARCHAR) END",
        "Cod_promo": f"CASE WHEN l_discount < 0.005 THEN '  ' ELSE {_CODE} END",
        "Nom_promo": _PROMO_NAME,
        "Costo_unit": f"concat({_COST_CENTS} // 100, '.', "
                      f"lpad(CAST({_COST_CENTS} % 100 AS VARCHAR), 2, '0'))",
        "Tipo": "l_returnflag",
        "Sistema": "l_linestatus",
    }
    cols = ", ".join(
        f"CASE WHEN {e} NOT IN ({_MISSING}) THEN {e} END AS {c}" for c, e in fields.items())
    return f"SELECT {cols} FROM {_JOIN}"


def _clean_text() -> str:
    def number(c: str) -> str:
        return f"COALESCE(TRY_CAST(trim({c}) AS DECIMAL(24,4)), 0)"

    return f"""
        SELECT Transaccion, Cod_prod, Tiendas, Categoria, Tipo, Sistema,
               substr(trim(Fecha_raw), 1, 4) || '-' || substr(trim(Fecha_raw), 5, 2) AS Anio_mes,
               substr(trim(Fecha_raw), 1, 4) || '-' || substr(trim(Fecha_raw), 5, 2) || '-'
                   || substr(trim(Fecha_raw), 7, 2) AS Fecha,
               {number('Cantidad')} AS Cantidad, {number('Precio')} AS Precio,
               {number('Importe')} AS Importe, {number('Costo_unit')} AS Costo_unit,
               NULLIF(trim(Cod_promo), '') AS Cod_promo, NULLIF(trim(Nom_promo), '') AS Nom_promo
        FROM texto WHERE length(trim(Fecha_raw)) = 8"""


CTES: dict[str, str] = {
    "ciclos": _ciclos(),
    "meses_ciclo": """
        SELECT strftime(mes, '%Y-%m') AS Anio_mes, ciclo || '-' || anio AS CicloAno_mes, ciclo
        FROM (SELECT *, unnest(generate_series(date_trunc('month', ini), fin, INTERVAL 1 MONTH))
                     AS mes FROM ciclos)
        WHERE mes + INTERVAL 14 DAY BETWEEN ini AND fin""",
    "lineas": f"""
        SELECT strftime({_DAY}, '%Y-%m-%d') AS Fecha, strftime({_DAY}, '%Y-%m') AS Anio_mes,
               {_STORE} AS Tiendas, CAST(l_orderkey AS VARCHAR) AS Transaccion,
               CAST(l_partkey AS VARCHAR) AS Cod_prod, {_NAME} AS Nom_prod,
               {_CATEGORY} AS Categoria, {_CODE} AS Cod_promo, {_PROMO_NAME} AS Nom_promo,
               l_returnflag AS Tipo, l_linestatus AS Sistema,
               l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3, l_extendedprice AS o4,
               CAST(l_quantity AS DECIMAL(18,4)) AS Cantidad,
               CAST({_NET} AS DECIMAL(18,4)) AS Importe,
               CAST(l_extendedprice AS DECIMAL(18,4)) AS Precio_x_Cant,
               CAST(l_extendedprice * (30 + l_partkey % 60) / 100 AS DECIMAL(18,4)) AS Costo_total,
               CAST({_CODE} IS NOT NULL AS INT) AS has_promo
        FROM {_JOIN}""",
    "ventas": f"SELECT *, {_code_parts('Cod_promo')} FROM lineas WHERE {_IN_MODEL}",
    "productos": f"SELECT * FROM lineas WHERE {_IN_MODEL}",
    "promo_prod": f"SELECT * FROM lineas WHERE {_IN_MODEL}",
    "ventas_dia": f"""
        SELECT lineas.*, {_week('Fecha')} AS Semana, COALESCE(CicloAno_mes, '') AS CicloAno_mes
        FROM lineas LEFT JOIN meses_ciclo USING (Anio_mes)""",
    "tickets": """
        SELECT Anio_mes, Tiendas, COUNT(Transaccion) AS n_tickets, SUM(has_promo) AS n_tkt_promo
        FROM (SELECT *, row_number() OVER (PARTITION BY Anio_mes, Tiendas, Transaccion
                                           ORDER BY o1, o2, o3, o4) AS nro FROM lineas)
        WHERE nro = 1 AND Tiendas IS NOT NULL GROUP BY ALL""",
    "tiendas": """
        SELECT CAST(s_suppkey AS VARCHAR) AS FileCORR, r_name AS Region, n_name AS Comuna,
               CASE s_suppkey % 3 WHEN 0 THEN 'Tienda' WHEN 1 THEN 'Express' ELSE 'Kiosco' END
                   AS Formato,
               CASE WHEN s_acctbal < 0 THEN 'C' WHEN s_acctbal < 5000 THEN 'B' ELSE 'A' END
                   AS Segmento
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "catalogo": f"""
        SELECT concat('C', c, '-', y, '-', n, '-', t) AS Cod_promo, concat('Promo ', n) AS Nom_promo,
               CASE WHEN n IN ('05', '06') THEN '2x' WHEN n = '10' THEN 'Cruzada' ELSE '3x' END
                   AS Formato_promo,
               CASE WHEN n IN ('05', '06', '10') THEN 2 ELSE 3 END AS Unidades_por_promo
        FROM (SELECT unnest(range(1, 7)) AS c), (SELECT unnest(range(2023, 2031)) AS y),
             (SELECT unnest(['05', '06', '08', '09', '10']) AS n), (SELECT unnest({_TIPOS}) AS t)""",
    "texto": _raw_text(),
    "limpio": _clean_text(),
    "codigos": """
        SELECT Cod_promo, Nom_promo FROM lineas WHERE Cod_promo IS NOT NULL GROUP BY ALL""",
}

# --- measures and keys ------------------------------------------------------------------------


def _over(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0)"


def _when(condition: str, column: str) -> str:
    return f"SUM(CASE WHEN {condition} THEN {column} ELSE 0 END)"


_I, _U, _C, _L = "SUM(Importe)", "SUM(Cantidad)", "SUM(Costo_total)", "SUM(Precio_x_Cant)"
_MARGIN, _DISCOUNT = "SUM(Importe - Costo_total)", "SUM(Precio_x_Cant - Importe)"
_CODED = "trim(COALESCE(Cod_promo, '')) <> ''"

MEASURE = {
    "Ingresos": _I, "Unidades": _U, "Costo": _C, "Ing_lista": _L, "Margen": _MARGIN,
    "Descuento": _DISCOUNT,
    "Tickets": "SUM(n_tickets)", "Tkt_promo": "SUM(n_tkt_promo)",
    "Ing_con_codigo": _when("Cod_promo IS NOT NULL", "Importe"),
    "Ing_sin_codigo": _when("Cod_promo IS NULL", "Importe"),
    "Und_con_codigo": _when(_CODED, "Cantidad"),
    "Und_sin_codigo": _when(f"NOT ({_CODED})", "Cantidad"),
    "Ing_codigo_no_vacio": _when(_CODED, "Importe"),
    "Cant_promo": _when("has_promo = 1", "Cantidad"),
    "Cant_sin_promo": _when("has_promo = 0", "Cantidad"),
    "Ing_promo": _when("has_promo = 1", "Importe"),
    "Ing_sin_promo": _when("has_promo = 0", "Importe"),
    "Costo_promo": _when("has_promo = 1", "Costo_total"),
    "Costo_sin_promo": _when("has_promo = 0", "Costo_total"),
    "Mg_pct": _over(_MARGIN, _I), "Desc_pct": _over(_DISCOUNT, _L), "ROI": _over(_I, _DISCOUNT),
    "Markup": _over(_MARGIN, _C), "Precio_ef": _over(_I, _U), "Precio_lista": _over(_L, _U),
    "Costo_unit": _over(_C, _U),
    "Mix_promo": _over(_when("Cod_promo IS NOT NULL", "Importe"), _I),
    "Penetracion": _over(_when("has_promo = 1", "Cantidad"), _U),
    "Penetracion_ing": _over(_when("has_promo = 1", "Importe"), _I),
    "Primer_mes": "MIN(Anio_mes)", "Ultimo_mes": "MAX(Anio_mes)",
    "Meses": "COUNT(DISTINCT Anio_mes)", "N_tiendas": "COUNT(DISTINCT Tiendas)",
    "N_promos": "COUNT(DISTINCT Cod_promo)",
}
_PROD = "COALESCE(NULLIF(trim(Nom_prod), ''), Cod_prod, '?')"
_PROMO = "COALESCE(NULLIF(trim(Nom_promo), ''), Cod_promo, '?')"
_MECHANIC = """CASE WHEN regexp_matches(lower(Nom_promo), '2 ?x') THEN '2x1 / 2x precio'
    WHEN regexp_matches(lower(Nom_promo), 'combo|pack') THEN 'Combo / Pack'
    WHEN regexp_matches(lower(Nom_promo), 'gratis|lleva') THEN 'Lleva X Gratis'
    WHEN regexp_matches(lower(Nom_promo), 'descuento| .* off') THEN 'Descuento Directo'
    WHEN regexp_matches(lower(Nom_promo), 'crm|um') THEN 'Promo CRM/Lealtad' ELSE 'Otras' END"""
KEY = {
    "month": ("Anio_mes", "Anio_mes"), "year": ("Anio", "substr(Anio_mes, 1, 4)"),
    "month_no": ("Mes", "substr(Anio_mes, 6, 2)"), "store": ("Tiendas", "Tiendas"),
    "cat": ("Categoria", "COALESCE(Categoria, '–')"),
    "sin_cat": ("Categoria", "COALESCE(Categoria, 'Sin cat.')"),
    "prod": ("Producto", _PROD), "prod_short": ("Prod", _PROD), "code": ("Codigo", "Cod_prod"),
    "promo": ("Promo", _PROMO), "promo_code": ("Cod_promo", "Cod_promo"),
    "cycle": ("Ciclo", "CicloAno_p"), "mechanic": ("Mecanica", _MECHANIC),
    "modality": ("Modalidad", "COALESCE(NULLIF(trim(TipoPromo), ''), 'Sin promo')"),
    "type": ("Tipo", "COALESCE(Tipo, '–')"), "system": ("Sistema", "COALESCE(Sistema, '–')"),
}


def agg(table: str, keys: str, columns: str, where: str = "", having: str = "",
        order: str = "", limit: int = 0) -> str:
    """One aggregation with unrounded results; lines are renamed so aliases cannot clash."""
    pairs = [KEY.get(k, (k, k)) for k in keys.split()]
    items = [f"{sql} AS {alias}" for alias, sql in pairs]
    for column in columns.split():
        alias, _, source = column.partition("=")
        items.append(f"{MEASURE[source or alias]} AS {alias}")
    text = f"SELECT {', '.join(items)} FROM {table}"
    if where:
        text += f" WHERE {where}"
    if pairs:
        text += " GROUP BY " + ", ".join(str(i + 1) for i in range(len(pairs)))
    if having:
        text += f" HAVING {having}"
    if limit:
        ties = ", ".join(f"{i + 1} NULLS LAST" for i in range(len(pairs)))
        text = f"SELECT * FROM ({text}) ORDER BY {order}, {ties} LIMIT {limit}"
    return text


_PROMOS = "Cod_promo IS NOT NULL"
_SPLIT = "Cant_promo Cant_sin_promo Cant_total=Unidades Penetracion"

# name: (columns of the result, query)
_REPORTS: list[tuple[str, str, str]] = [
    ("kpis_v", "ing und costo margen mg_pct ing_lista desc_total desc_pct ing_promo n_promos",
     agg("ventas", "", "ing=Ingresos und=Unidades costo=Costo margen=Margen mg_pct=Mg_pct "
         "ing_lista=Ing_lista desc_total=Descuento desc_pct=Desc_pct ing_promo=Ing_con_codigo "
         "n_promos=N_promos")),
    ("kpis_t", "tkt tkt_p tiendas", agg("tickets", "", "tkt=Tickets tkt_p=Tkt_promo tiendas=N_tiendas")),
    ("treemap", "Categoria Ingresos Margen Mg_pct", agg("ventas", "sin_cat", "Ingresos Margen Mg_pct")),
    ("pareto", "Prod Margen",
     agg("productos", "prod_short", "Margen", having=f"{_MARGIN} > 0", order="Margen DESC", limit=150)),
    ("evol_v", "Anio_mes Ingresos Margen Mg_pct Descuento",
     agg("ventas", "month", "Ingresos Margen Mg_pct Descuento")),
    ("evol_t", "Anio_mes Tickets", agg("tickets", "month", "Tickets")),
    ("prod_mg", "Producto Codigo Categoria Ingresos Unidades Costo Margen Mg_pct Markup Precio_ef Costo_unit",
     agg("productos", "prod code cat",
         "Ingresos Unidades Costo Margen Mg_pct Markup Precio_ef Costo_unit",
         order="Ingresos DESC", limit=500)),
    ("precio_evol", "Anio_mes Categoria Precio_ef Precio_lista Costo_unit Mg_pct Ingresos Unidades",
     agg("ventas", "month sin_cat", "Precio_ef Precio_lista Costo_unit Mg_pct Ingresos Unidades")),
    ("pvol", "Producto Categoria Precio_ef Unidades Ingresos Mg_pct",
     agg("productos", "prod cat", "Precio_ef Unidades Ingresos Mg_pct", order="Ingresos DESC", limit=300)),
    ("compresion", "Producto Categoria n_meses Precio_inicio Precio_fin Costo_inicio Costo_fin "
     "Cambio_precio_pct Cambio_costo_pct Mg_inicio_pct Mg_fin_pct Delta_mg",
     f"""SELECT Producto, Categoria, COUNT(*) AS n_meses,
            ROUND(FIRST(p ORDER BY Anio_mes), 0) AS Precio_inicio,
            ROUND(LAST(p ORDER BY Anio_mes), 0) AS Precio_fin,
            ROUND(FIRST(c ORDER BY Anio_mes), 0) AS Costo_inicio,
            ROUND(LAST(c ORDER BY Anio_mes), 0) AS Costo_fin,
            ROUND((LAST(p ORDER BY Anio_mes) - FIRST(p ORDER BY Anio_mes))
                / NULLIF(FIRST(p ORDER BY Anio_mes), 0) * 100, 1) AS Cambio_precio_pct,
            ROUND((LAST(c ORDER BY Anio_mes) - FIRST(c ORDER BY Anio_mes))
                / NULLIF(FIRST(c ORDER BY Anio_mes), 0) * 100, 1) AS Cambio_costo_pct,
            ROUND(FIRST(m ORDER BY Anio_mes) * 100, 1) AS Mg_inicio_pct,
            ROUND(LAST(m ORDER BY Anio_mes) * 100, 1) AS Mg_fin_pct,
            ROUND(LAST(m ORDER BY Anio_mes) - FIRST(m ORDER BY Anio_mes), 3) AS Delta_mg
        FROM ({agg('productos', 'prod cat month', 'p=Precio_ef c=Costo_unit m=Mg_pct')})
        GROUP BY ALL HAVING COUNT(*) >= 3 AND FIRST(c ORDER BY Anio_mes) > 0
            AND FIRST(p ORDER BY Anio_mes) > 0
        ORDER BY Delta_mg NULLS LAST, Producto, Categoria LIMIT 200"""),
    ("promos", "Promo Cod_promo Primer_mes Ultimo_mes Meses Tiendas Ingresos Unidades Margen Mg_pct "
     "Descuento Desc_pct ROI",
     agg("ventas", "promo promo_code", "Primer_mes Ultimo_mes Meses Tiendas=N_tiendas Ingresos "
         "Unidades Margen Mg_pct Descuento Desc_pct ROI", _PROMOS)),
    ("heatmap_promo", "Promo Anio_mes Ingresos",
     agg("ventas", "promo month", "Ingresos", f"{_PROMOS} AND {_PROMO} IN (SELECT Promo FROM ("
         + agg("ventas", "promo promo_code", "Ingresos", _PROMOS, order="Ingresos DESC", limit=20)
         + "))")),
    ("mecanica", "Mecanica Promos Ingresos Margen Mg_pct Inversion ROI",
     agg("ventas", "mechanic", "Promos=N_promos Ingresos Margen Mg_pct Inversion=Descuento ROI", _PROMOS)),
    ("tiendas_v", "Tiendas Ingresos Unidades Costo Margen Mg_pct Desc_pct Precio_lista Precio_ef Mix_promo",
     agg("ventas", "store", "Ingresos Unidades Costo Margen Mg_pct Desc_pct Precio_lista Precio_ef "
         "Mix_promo", "Tiendas IS NOT NULL")),
    ("tiendas_t", "Tiendas Tickets Tkt_promo", agg("tickets", "store", "Tickets Tkt_promo")),
    ("heat_tiendas", "Tiendas Anio_mes Ingresos",
     agg("ventas", "store month", "Ingresos", "Tiendas IN (SELECT Tiendas FROM ("
         + agg("ventas", "store", "Ingresos", "Tiendas IS NOT NULL", order="Ingresos DESC", limit=20)
         + "))")),
    ("alertas", "Producto Categoria Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef Costo_unit Desc_pct",
     agg("productos", "prod cat", "Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef "
         "Costo_unit Desc_pct", having=f"{_I} > 100")),
    ("alertas_promo", "Promo Ingresos Inversion ROI Desc_pct Mg_pct",
     agg("ventas", "promo", "Ingresos Inversion=Descuento ROI Desc_pct Mg_pct", _PROMOS, f"{_I} > 100")),
    ("ticket_promo_mes", "Anio_mes Ing_promo Ing_sin_promo Ing_total Tkts_total Tkts_promo "
     "Tkts_sin_promo Tkt_con_promo Tkt_sin_promo Tkt_promedio",
     f"""SELECT *, t - p AS Tkts_sin_promo, t AS Tkts_total, p AS Tkts_promo,
            {_over('Ing_promo', 'p')} AS Tkt_con_promo,
            {_over('Ing_sin_promo', '(t - p)')} AS Tkt_sin_promo,
            {_over('Ing_total', 't')} AS Tkt_promedio
        FROM ({agg('ventas', 'month',
              'Ing_promo=Ing_con_codigo Ing_sin_promo=Ing_sin_codigo Ing_total=Ingresos')})
        JOIN ({agg('tickets', 'month', 't=Tickets p=Tkt_promo')}) USING (Anio_mes)"""),
    ("ticket_promo_cat", "Categoria Ing_promo Ing_sin_promo Ing_total Tkt_con_promo_ref "
     "Ing_promo_total Mix_cat_promo",
     f"""SELECT *, {_over('Ing_promo', '(SELECT SUM(n_tkt_promo) FROM tickets)')} AS Tkt_con_promo_ref,
            SUM(Ing_promo) OVER () AS Ing_promo_total,
            {_over('Ing_promo', 'SUM(Ing_promo) OVER ()')} AS Mix_cat_promo
        FROM ({agg('ventas', 'cat',
              'Ing_promo=Ing_con_codigo Ing_sin_promo=Ing_sin_codigo Ing_total=Ingresos')})"""),
    ("sku_por_promo", "Promo Cod_promo Categoria Tiendas Ingresos Unidades Mg_pct Desc_pct ROI "
     "Primer_mes Ultimo_mes",
     agg("ventas", "promo promo_code cat", "Tiendas=N_tiendas Ingresos Unidades Mg_pct Desc_pct ROI "
         "Primer_mes Ultimo_mes", _PROMOS)),
    ("evo_ciclo", "Ciclo Categoria Promo Cod_promo Ingresos Unidades Tiendas Mg_pct",
     agg("ventas", "cycle cat promo promo_code", "Ingresos Unidades Tiendas=N_tiendas Mg_pct",
         f"{_PROMOS} AND CicloAno_p <> ''")),
    ("modalidad_venta", "Modalidad Categoria Ingresos Unidades",
     agg("ventas", "modality cat", "Ingresos Unidades", _PROMOS)),
    ("pen_cat_v", "Categoria Unidades_total Unidades_promo Unidades_sin_promo Ingresos_total Ingresos_promo",
     agg("ventas", "cat", "Unidades_total=Unidades Unidades_promo=Und_con_codigo "
         "Unidades_sin_promo=Und_sin_codigo Ingresos_total=Ingresos "
         "Ingresos_promo=Ing_codigo_no_vacio")),
    ("promo_por_cat_ciclo", "Categoria Promo Anio_mes Ingresos Unidades Tiendas Mg_pct",
     agg("ventas", "cat promo month", "Ingresos Unidades Tiendas=N_tiendas Mg_pct", _PROMOS)),
    ("penetracion_prod", "Producto Categoria Cant_promo Cant_sin_promo Cant_total Penetracion Ing_promo "
     "Ing_sin_promo Ingresos Costo_promo Costo_sin_promo",
     agg("promo_prod", "prod cat", _SPLIT + " Ing_promo Ing_sin_promo Ingresos Costo_promo "
         "Costo_sin_promo", having=f"{_U} > 0")),
    ("penetracion_mes", "Anio_mes Cant_promo Cant_sin_promo Cant_total Penetracion Ing_promo "
     "Ing_sin_promo Ingresos",
     agg("promo_prod", "month", _SPLIT + " Ing_promo Ing_sin_promo Ingresos")),
    ("penetracion_cat", "Categoria Cant_promo Cant_sin_promo Cant_total Penetracion Penetracion_ing Ingresos",
     agg("promo_prod", "cat", _SPLIT + " Penetracion_ing Ingresos")),
    ("penetracion_cat_mes", "Categoria Anio_mes Penetracion",
     agg("promo_prod", "cat month", "Penetracion")),
    ("mg_cat_mes", "Categoria Anio_mes Mg_pct Ingresos",
     agg("ventas", "sin_cat month", "Mg_pct Ingresos")),
    ("desc_mg_prod", "Producto Categoria Desc_pct Mg_pct Ingresos Unidades",
     agg("productos", "prod cat", "Desc_pct Mg_pct Ingresos Unidades", having=f"{_I} > 10000")),
    ("cat_promo_cross", "Categoria Ingresos Mix_promo Mg_pct Desc_pct",
     agg("ventas", "sin_cat", "Ingresos Mix_promo Mg_pct Desc_pct")),
    ("precio_gap", "Anio_mes Categoria Precio_lista Precio_ef Gap_pct Ingresos",
     agg("ventas", "month sin_cat", "Precio_lista Precio_ef Gap_pct=Desc_pct Ingresos")),
    ("yoy_mes", "Anio_mes Anio Mes Ingresos Unidades Margen Mg_pct Mix_promo",
     agg("ventas", "month year month_no", "Ingresos Unidades Margen Mg_pct Mix_promo")),
    ("yoy_cat", "Categoria Anio Ingresos Unidades Margen Mg_pct",
     agg("ventas", "cat year", "Ingresos Unidades Margen Mg_pct")),
    ("sku_ranking", "Producto Categoria Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef Desc_pct "
     "Primer_mes Ultimo_mes",
     agg("productos", "prod cat", "Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef Desc_pct "
         "Primer_mes Ultimo_mes", having=f"{_I} > 0", order="Ingresos DESC", limit=500)),
    ("price_ladder", "Producto Categoria Precio_ef Precio_lista Ingresos Unidades Mg_pct",
     agg("productos", "prod cat", "Precio_ef Precio_lista Ingresos Unidades Mg_pct",
         having=f"{_I} > 10000")),
    ("cobertura_prod", "Categoria N_tiendas Ingresos Unidades Mg_pct Desc_pct",
     agg("ventas", "cat", "N_tiendas Ingresos Unidades Mg_pct Desc_pct", having=f"{_I} > 0")),
    ("resumen_export", "Anio_mes Tiendas Categoria Tipo Sistema Ingresos Unidades Costo Margen "
     "Margen_pct Descuento Promos_distintas",
     "SELECT *, ROUND(Mg_pct * 100, 2) AS Margen_pct FROM ("
     + agg("ventas", "month store cat type system", "Ingresos Unidades Costo Margen Mg_pct "
           "Descuento Promos_distintas=N_promos") + ")"),
]
REPORT_SQL = {name: sql for name, _, sql in _REPORTS}
REPORT_COLUMNS = {name: columns for name, columns, _ in _REPORTS}
CTES.update({f"r_{name}": sql for name, sql in REPORT_SQL.items()})


# --- assembling -------------------------------------------------------------------------------

def _needed(text: str, ctes: dict[str, str]) -> set[str]:
    found: set[str] = set()
    stack = [text]
    while stack:
        current = stack.pop()
        for name in ctes:
            if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+\(?{name}\b", current):
                found.add(name)
                stack.append(ctes[name])
    return found


def sql(columns: str, body: str, **override: str) -> str:
    """A full statement: the needed base tables, the body, typed output columns."""
    return statement(", ".join(_typed(c) for c in columns.split()), body, **override)


def statement(out: str, body: str, **override: str) -> str:
    """As ``sql`` with the output list spelled out."""
    ctes = {**CTES, **override}
    names = [n for n in ctes if n in _needed(body, ctes)]
    ordered = sorted(names, key=lambda n: _depth(n, ctes))
    head = ",\n".join(f"{n} AS ({ctes[n]})" for n in ordered)
    prefix = f"WITH {head}\n" if head else ""
    return f"{prefix}SELECT {out} FROM ({body})"


def _depth(name: str, ctes: dict[str, str]) -> int:
    parents = _needed(ctes[name], ctes) - {name}
    return 1 + max((_depth(p, ctes) for p in parents), default=0)


def _report_oracles() -> dict[str, str]:
    return {
        f"q{i:02d}_{name}": sql(columns, body)
        for i, (name, columns, body) in enumerate(_REPORTS, 1)
    }


def all_oracles() -> dict[str, str]:
    from checks.oracle_analytics import analytics
    from checks.queries import SHARED
    from checks.oracle_rows import rows_and_filters

    own = {**rows_and_filters(), **_report_oracles(), **analytics()}
    return own | {name: own[source] for name, source in SHARED.items()}
