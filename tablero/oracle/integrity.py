"""Checking SQL for the integrity and rollup jobs and the typed sources."""

from __future__ import annotations

import re

from tablero import schemas
from tablero.oracle.kit import AS_OF, LIVE, tables
from tablero.oracle.views import SQL as VIEWS
from tablero.sources.retail import EXPRESSIONS

SQL: dict[str, str] = {}

SQL["m_line_total"] = f"""{tables("ordenes", "items_orden")}
SELECT orden_id, producto_id, cantidad, precio_unitario, porcentaje_descuento,
  CAST((cantidad * precio_unitario * (100 - porcentaje_descuento))
    * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS total_linea
FROM items_orden"""

_SUM_OF = "coalesce((SELECT sum(total_linea) FROM {} i WHERE i.orden_id = o.id), 0)"
_REST = "+ monto_impuesto + costo_envio - monto_descuento"
SQL["m_order_totals"] = f"""{tables("ordenes", "items_orden")}
SELECT id, CAST({_SUM_OF.format("items_orden")} {_REST} AS DECIMAL(15,2)) AS monto_total
FROM ordenes o"""

SQL["m_order_totals_delta"] = f"""{tables("ordenes", "items_orden")},
kept AS (SELECT * FROM items_orden WHERE cantidad_devuelta = 0)
SELECT id, CASE WHEN id IN (SELECT orden_id FROM items_orden WHERE cantidad_devuelta > 0)
  THEN CAST({_SUM_OF.format("kept")} {_REST} AS DECIMAL(15,2)) ELSE monto_total END AS monto_total
FROM ordenes o"""


def _ltv() -> str:
    return f"""{tables("ordenes", "clientes")}
SELECT c.id, CAST(coalesce(sum(monto_total), 0) AS DECIMAL(15,2)) AS valor_vida_total,
  max(fecha_orden) AS fecha_ultima_compra
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id AND {LIVE} GROUP BY c.id"""


SQL["m_client_ltv"] = _ltv()

SQL["m_soft_delete"] = f"""{tables("clientes")}
SELECT id, activo AND NOT fecha_adquisicion < {AS_OF} - INTERVAL '6 months' AS activo FROM clientes"""

_DELETIONS = {
    "vendedores inactivos": {
        "vendedores": ("activo", "gerente_id IN (SELECT id FROM vendedores WHERE activo)"),
        "ordenes": ("true", "vendedor_id IN (SELECT id FROM vendedores WHERE activo)"),
        "interacciones_clientes": ("true", "false"),
    },
    "campanas canceladas": {
        "campanas": ("estado <> 'cancelada'", None),
        "campanas_clientes": (
            "campana_id IN (SELECT id FROM campanas WHERE estado <> 'cancelada')", None),
    },
    "ordenes canceladas": {
        "ordenes": ("id NOT IN (SELECT id FROM free)", None),
        "items_orden": ("orden_id NOT IN (SELECT id FROM free)", None),
    },
}
_SUMMARIES = [
    f"SELECT '{what}' AS borrado, '{table}' AS tabla, count(*) AS filas, "
    + (f"count(*) FILTER (WHERE {linked})" if linked else "CAST(NULL AS BIGINT)")
    + f" AS con_referencia FROM {table} WHERE {kept}"
    for what, parts in _DELETIONS.items()
    for table, (kept, linked) in parts.items()
]
SQL["m_delete_cascade"] = f"""{tables("vendedores", "ordenes", "items_orden", "pagos",
  "devoluciones", "interacciones_clientes", "campanas", "campanas_clientes")},
free AS (SELECT id FROM ordenes WHERE estado = 'cancelado' AND id NOT IN
  (SELECT orden_id FROM pagos UNION SELECT orden_id FROM devoluciones))
""" + "\nUNION ALL ".join(_SUMMARIES)


# Amounts by table with their declared precision and scale.
_AMOUNTS = {
    "clientes": {"limite_credito": "15,2", "valor_vida_total": "15,2"},
    "productos": {"precio_lista": "10,2", "precio_costo": "10,2", "peso_kg": "8,2",
                  "volumen_m3": "8,3"},
    "vendedores": {"tasa_comision": "5,2", "cuota_mensual": "15,2"},
    "ordenes": {"subtotal": "15,2", "monto_descuento": "15,2", "porcentaje_descuento": "5,2",
                "monto_impuesto": "15,2", "costo_envio": "15,2", "monto_total": "15,2"},
    "items_orden": {"precio_unitario": "10,2", "porcentaje_descuento": "5,2",
                    "total_linea": "15,2"},
    "pagos": {"monto": "15,2"},
    "devoluciones": {"monto_reembolso": "15,2"},
    "campanas": {"presupuesto": "15,2", "gasto_real": "15,2", "ingresos_generados": "15,2"},
}

# Rows that break a rule of each kind, by table and column.
_PLANTED = {
    "clientes": {
        "nombre": "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN repeat('n', 300) "
                  "ELSE nombre END",
        "segmento": "CASE WHEN id % 70 = 1 THEN 'oro' ELSE segmento END",
        "email": "CASE WHEN id % 90 = 2 THEN 'c1@empresa.com' WHEN id % 90 = 3 THEN NULL "
                 "ELSE email END",
        "limite_credito": "CAST(limite_credito AS DECIMAL(22,4)) + CASE WHEN id % 20 = 4 THEN "
                          "CAST('0.0050' AS DECIMAL(22,4)) WHEN id % 20 = 5 THEN "
                          "CAST('90000000000000' AS DECIMAL(22,4)) ELSE 0 END",
    },
    "ordenes": {
        "id": "CASE WHEN id % 100 = 7 THEN id - 1 ELSE id END",
        "cliente_id": "CASE WHEN id % 200 = 9 THEN -id WHEN id % 200 = 10 THEN NULL "
                      "ELSE cliente_id END",
        "vendedor_id": "CASE WHEN id % 300 = 11 THEN -3 ELSE vendedor_id END",
        "estado": "CASE WHEN id % 400 = 12 THEN 'perdido' ELSE estado END",
    },
    "items_orden": {
        "cantidad": "CASE WHEN orden_id % 300 = 5 THEN 0 ELSE cantidad END",
        "producto_id": "CASE WHEN orden_id % 500 = 6 THEN 0 ELSE producto_id END",
    },
    "campanas_clientes": {
        "campana_id": "CASE WHEN id % 40 = 1 THEN 99 ELSE campana_id END",
        "cliente_id": "CASE WHEN id % 40 = 2 THEN 1 ELSE cliente_id END",
    },
}


def _constraints(planted: dict[str, dict[str, str]]) -> str:
    text = "CAST({} AS VARCHAR)".format
    rows: list[tuple[str, str, str, str]] = []

    def row_rule(table: str, rule: str, kind: str, broken: str) -> None:
        # Line ids of the mapped tables differ from scan to scan.
        smallest = "'-'" if table == "items_orden" else text("min(id)")
        rows.append((table, rule, kind, f"SELECT count(*) AS v, CASE WHEN count(*) > 0 THEN "
                     f"{smallest} END AS e FROM {table} WHERE {broken}"))

    def is_known(table: str, *columns: str) -> bool:
        return all(c in EXPRESSIONS[table] or c in planted.get(table, {}) for c in columns)

    none = "SELECT 0 AS v, CAST(NULL AS VARCHAR) AS e"
    for table in EXPRESSIONS:
        for column in ("id", *schemas.REQUIRED[table]):
            row_rule(table, column, "no_nulo", f"{column} IS NULL")
        for rule, condition in schemas.CHECKS.get(table, {}).items():
            row_rule(table, rule, "check", f"NOT ({condition})")
        for column, values in schemas.DOMAINS.get(table, {}).items():
            words = ", ".join(f"'{v}'" for v in values)
            row_rule(table, column, "dominio", f"{column} NOT IN ({words})")
        for column, most in schemas.LENGTHS.get(table, {}).items():
            if is_known(table, column):
                row_rule(table, column, "longitud", f"length({column}) > {most}")
            else:
                rows.append((table, column, "longitud", none))
        for column, kind in _AMOUNTS.get(table, {}).items():
            if column in planted.get(table, {}):
                row_rule(table, column, "precision", f"{column} IS NOT NULL AND {column} IS "
                         f"DISTINCT FROM TRY_CAST({column} AS DECIMAL({kind}))")
            else:
                rows.append((table, column, "precision", none))
        for key in schemas.UNIQUE[table]:
            value = " || ',' || ".join(text(c) for c in key)
            rows.append((table, ",".join(key), "unico", (
                f"SELECT coalesce(sum(n - 1), 0) AS v, min(k) AS e FROM (SELECT {value} AS k, "
                f"count(*) AS n FROM {table} WHERE {value} IS NOT NULL GROUP BY 1 "
                f"HAVING count(*) > 1)") if is_known(table, *key) else none))
    for ref in schemas.REFERENCES:
        rows.append((ref.child, f"{ref.column} -> {ref.parent}", "referencia", (
            f"SELECT count(*) AS v, min({text(ref.column)}) AS e FROM {ref.child} c "
            f"WHERE {ref.column} IS NOT NULL AND "
            f"NOT EXISTS (SELECT 1 FROM {ref.parent} p WHERE p.id = c.{ref.column})")
            if is_known(ref.child, ref.column) else none))
    body = "\nUNION ALL ".join(
        f"SELECT '{t}' AS tabla, '{rule}' AS regla, '{kind}' AS tipo, "
        f"CAST(v AS BIGINT) AS violaciones, e AS ejemplo FROM ({sql})"
        for t, rule, kind, sql in rows
    )
    head = tables(*EXPRESSIONS)
    for table, columns in planted.items():
        # Tables that were mapped from a changed one keep the rows they had.
        changed = ", ".join(f"{value} AS {column}" for column, value in columns.items())
        head += (f",\n{table}_mal AS (SELECT * REPLACE ({changed}) FROM {table})"
                 if set(columns) <= set(EXPRESSIONS[table]) else "")
        body = re.sub(rf"FROM {table}\b", f"FROM {table}_mal", body)
    return f"{head}\n{body}"


SQL["m_constraints"] = _constraints({})
SQL["m_constraints_plantadas"] = _constraints(_PLANTED)

SQL["m_refresh_mvs"] = f"""SELECT 'mv_tendencia_ventas_mensual' AS nombre_vista,
  'completado' AS estado, (SELECT count(*) FROM ({VIEWS["mv_tendencia_ventas_mensual"]})) AS filas
UNION ALL SELECT 'mv_top_productos_por_categoria', 'completado',
  (SELECT count(*) FROM ({VIEWS["mv_top_productos_por_categoria"]}))"""

SQL["src_tables"] = tables(*EXPRESSIONS) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS tabla, count(*) AS filas, "
    f"CAST({len(EXPRESSIONS[t])} AS INTEGER) AS columnas_con_datos FROM {t}" for t in EXPRESSIONS
)

SQL["sink_fact_export"] = f"""SELECT CAST(date_trunc('month', fecha_orden) AS DATE) AS mes,
  count(*) AS filas, CAST(sum(total_linea) AS DECIMAL(25,2)) AS importe
FROM ({VIEWS["q23_export_hechos"]}) GROUP BY 1"""

SQL["src_calendar"] = f"""{tables("ordenes")},
days AS (SELECT CAST(d AS DATE) AS fecha FROM range({AS_OF} - INTERVAL '3 years',
  {AS_OF} + INTERVAL '1 year' + INTERVAL '1 day', INTERVAL '1 day') r(d)),
per_day AS (SELECT CAST(fecha_orden AS DATE) AS fecha, count(*) AS n FROM ordenes GROUP BY 1)
SELECT fecha, CAST(year(fecha) AS INTEGER) AS anio, CAST(month(fecha) AS INTEGER) AS mes,
  CAST(day(fecha) AS INTEGER) AS dia, strftime(fecha, '%Y-%m') AS anio_mes,
  CAST(isodow(fecha) AS INTEGER) AS dia_semana_num, dayname(fecha) AS nombre_dia,
  monthname(fecha) AS nombre_mes, isodow(fecha) IN (6, 7) AS es_fin_semana,
  coalesce(n, 0) AS cantidad_ordenes
FROM days LEFT JOIN per_day USING (fecha)"""
