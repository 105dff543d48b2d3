"""Checking SQL for the keys over stored facts and results, and for the loads."""

from __future__ import annotations

from tablero.oracle.integrity import SQL as JOBS
from tablero.oracle.kit import AS_OF, LIVE, money, month, tables
from tablero.oracle.views import SQL as VIEWS
from tablero.sources.retail import EXPRESSIONS

SQL: dict[str, str] = {
    "sink_materialized": VIEWS["mv_tendencia_ventas_mensual"],
    "m_order_totals_en_sitio": JOBS["m_order_totals"],
    "q23_export_en_sitio": VIEWS["q23_export_hechos"],
}

SQL["sink_overwrite_load"] = f"""{tables("ordenes")}
SELECT id, estado, fecha_orden,
  CASE WHEN estado = 'cancelado' THEN CAST(0 AS DECIMAL(15,2)) ELSE monto_total END AS monto_total
FROM ordenes"""

SQL["sink_audit_append"] = tables(*EXPRESSIONS) + "\n" + "\nUNION ALL ".join(
    f"SELECT CAST({AS_OF} AS TIMESTAMP) AS fecha_carga, 'inicial' AS tipo_carga, "
    f"count(*) AS registros_afectados, 'completado' AS estado, '{t}' AS notas FROM {t}"
    for t in EXPRESSIONS)

SQL["sink_hechos_por_orden"] = f"""{tables("ordenes", "items_orden")},
o AS (SELECT {month("fecha_orden")} AS mes, count(*) AS ordenes,
  {money("sum(monto_total)")} AS monto FROM ordenes GROUP BY 1),
l AS (SELECT {month("fecha_orden")} AS mes, count(*) AS lineas,
  {money("sum(i.total_linea)")} AS importe
  FROM items_orden i LEFT JOIN ordenes o ON o.id = i.orden_id GROUP BY 1)
SELECT coalesce(o.mes, l.mes) AS mes, ordenes, monto, lineas, importe
FROM o FULL JOIN l ON o.mes = l.mes"""


def _changed(sql: str) -> str:
    """The SQL over the model after the change set: its two fact tables are replaced."""
    some = f"fecha_orden >= {AS_OF} - INTERVAL '3 months'"
    total = ("CAST(coalesce((SELECT sum(total_linea) FROM items_orden i WHERE i.orden_id = o.id), 0)"
             " + monto_impuesto + costo_envio - monto_descuento AS DECIMAL(15,2))")
    changes = f""",
lost AS (SELECT i.orden_id FROM items_antes i JOIN ordenes_antes o ON o.id = i.orden_id
  WHERE cantidad_devuelta > 0 AND {some}),
items_orden AS (SELECT * FROM items_antes
  WHERE NOT (cantidad_devuelta > 0 AND orden_id IN (SELECT orden_id FROM lost))),
ordenes AS (SELECT * REPLACE (
  CASE WHEN estado = 'devuelto' AND {some} THEN 'cancelado' ELSE estado END AS estado,
  CASE WHEN id IN (SELECT orden_id FROM lost) THEN {total} ELSE monto_total END AS monto_total)
  FROM ordenes_antes o)"""
    names = ("ordenes", "items_orden", "clientes", "productos")
    given = tables(*names).replace("\nordenes AS (", "\nordenes_antes AS (").replace(
        "WITH ordenes AS (", "WITH ordenes_antes AS (").replace("\nitems_orden AS (",
                                                               "\nitems_antes AS (")
    return f"{given}{changes}{sql}"


def _body(sql: str, *names: str) -> str:
    """What follows the mapped tables in a checking SQL."""
    head = tables(*names)
    assert sql.startswith(head)
    return sql[len(head):]


SQL["m_order_totals_cambios"] = _changed("\nSELECT id, monto_total FROM ordenes")
SQL["m_client_ltv_cambios"] = _changed(f"""
SELECT c.id, CAST(coalesce(sum(monto_total), 0) AS DECIMAL(15,2)) AS valor_vida_total,
  max(fecha_orden) AS fecha_ultima_compra
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id AND {LIVE} GROUP BY c.id""")
_FACTS = ("ordenes", "items_orden", "productos")
SQL["m_refresh_mvs_cambios"] = _changed(_body(VIEWS["mv_tendencia_ventas_mensual"], *_FACTS))
SQL["m_refresh_ranking_cambios"] = _changed(_body(VIEWS["mv_top_productos_por_categoria"], *_FACTS))
