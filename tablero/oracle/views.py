"""Checking SQL for the views and the dashboard queries."""

from __future__ import annotations

from tablero.oracle.kit import (
    AS_OF, IN_MONTH, LIVE, OPEN_PAYMENT, UNPAID, age, average, cents, day, fraction, money, month,
    n_if, pct, quotient, since, sum_if, tables,
)

SQL: dict[str, str] = {}


def _daily(bound: str) -> str:
    return f"""{tables("ordenes")}
SELECT {day("fecha_orden")} AS fecha_venta,
  count(DISTINCT id) AS cantidad_ordenes,
  count(DISTINCT cliente_id) AS clientes_unicos,
  count(DISTINCT vendedor_id) AS vendedores_involucrados,
  {money("sum(monto_total)")} AS ingresos_totales,
  {average("monto_total", 6)} AS valor_promedio_orden,
  min(monto_total) AS orden_minima, max(monto_total) AS orden_maxima,
  {money("sum(subtotal)")} AS suma_subtotales,
  {money("sum(monto_descuento)")} AS total_descuentos,
  {money("sum(monto_impuesto)")} AS total_impuestos,
  {money("sum(costo_envio)")} AS total_envios,
  {n_if("estado = 'entregado'")} AS ordenes_entregadas,
  {n_if("estado = 'cancelado'")} AS ordenes_canceladas,
  {n_if("estado_pago = 'pagado'")} AS ordenes_pagadas,
  {n_if("estado_pago = 'pendiente'")} AS ordenes_pago_pendiente
FROM ordenes WHERE {bound} GROUP BY 1"""


SQL["v_resumen_ventas_diario"] = _daily(since("fecha_orden", "2 years"))
# From the first of the month on; a later day counts too.
FROM_MONTH = f"fecha_orden >= date_trunc('month', {AS_OF})"
SQL["d01_resumen_mes"] = _daily(FROM_MONTH)

_CATEGORY = f"""{tables("ordenes", "items_orden", "productos")},
sold AS (
  SELECT categoria, subcategoria, i.orden_id, cantidad, total_linea, precio_unitario,
    cantidad * precio_costo AS costo, cliente_id, cantidad_devuelta
  FROM ordenes o, items_orden i, productos p
  WHERE i.orden_id = o.id AND i.producto_id = p.id AND o.{LIVE}
)
"""
_CATEGORY_MARGIN = pct(f"{cents('sum(total_linea)')} - {cents('sum(costo)')}",
                       cents("sum(total_linea)"))
SQL["v_ventas_por_categoria"] = _CATEGORY + f"""SELECT categoria, subcategoria,
  count(DISTINCT orden_id) AS cantidad_ordenes, count(*) AS unidades_vendidas,
  CAST(sum(cantidad) AS BIGINT) AS cantidad_total, {money("sum(total_linea)")} AS ingresos_totales,
  {average("precio_unitario", 6)} AS precio_unitario_promedio,
  {money("sum(costo)")} AS costo_total,
  {money("sum(total_linea) - sum(costo)")} AS ganancia_bruta,
  {_CATEGORY_MARGIN} AS margen_ganancia_pct,
  count(DISTINCT cliente_id) AS clientes_unicos,
  CAST(sum(cantidad_devuelta) AS BIGINT) AS unidades_devueltas
FROM sold GROUP BY ALL"""
SQL["d10_margen_categoria"] = _CATEGORY + f"""SELECT categoria, subcategoria,
  {_CATEGORY_MARGIN} AS margen_ganancia_pct, {money("sum(total_linea)")} AS ingresos_totales
FROM sold GROUP BY ALL"""

_REP = f"""{tables("ordenes", "vendedores")},
joined AS (
  SELECT v.id, v.uuid, v.nombre, equipo, territorio, cuota_mensual, tasa_comision,
    o.id AS oid, cliente_id, monto_total, fecha_orden, estado, estado_pago,
    monto_total * tasa_comision * CAST('0.01' AS DECIMAL(3,2)) AS comision
  FROM (SELECT * FROM vendedores WHERE activo) v
  LEFT JOIN (SELECT * FROM ordenes WHERE {LIVE}) o ON o.vendedor_id = v.id
),
per_rep AS (
  SELECT id, uuid, nombre, equipo, territorio, cuota_mensual,
    count(DISTINCT oid) AS total_ordenes, count(DISTINCT cliente_id) AS clientes_unicos,
    {money("sum(monto_total)")} AS ventas_totales,
    {average("monto_total", 6)} AS valor_promedio_orden,
    CAST(sum(monto_total) - sum(comision) AS DECIMAL(31,6)) AS ventas_netas,
    CAST(sum(comision) AS DECIMAL(31,6)) AS monto_comision,
    count(DISTINCT CAST(fecha_orden AS DATE)) AS dias_activos_venta,
    {n_if("estado = 'entregado'")} AS ordenes_entregadas,
    {n_if("estado = 'cancelado'")} AS ordenes_canceladas,
    {n_if("estado_pago = 'pendiente'")} AS ordenes_sin_pago,
    {sum_if("monto_total", IN_MONTH)} AS ventas_mes_actual,
    max(fecha_orden) AS fecha_ultima_venta,
    {age("max(fecha_orden)")} AS dias_desde_ultima_venta
  FROM joined GROUP BY ALL
),
vista AS (
  SELECT *, {pct(cents("ventas_mes_actual"), cents("cuota_mensual"))}
    AS porcentaje_cumplimiento_cuota
  FROM per_rep
)
"""
SQL["v_performance_vendedores"] = _REP + "SELECT * FROM vista"
SQL["d05_top_vendedores"] = _REP + """SELECT nombre, ventas_totales, porcentaje_cumplimiento_cuota
FROM vista ORDER BY ventas_totales DESC NULLS LAST, id LIMIT 10"""


def _segmentation(fan_out: bool) -> str:
    # Without fan-out, interactions are reduced to one row per client before the join.
    contacts = (
        "SELECT cliente_id, id AS ic, 1 AS n, fecha_interaccion FROM interacciones_clientes"
        if fan_out
        else "SELECT cliente_id, min(id) AS ic, count(*) AS n, max(fecha_interaccion) AS "
        "fecha_interaccion FROM interacciones_clientes GROUP BY cliente_id"
    )
    interactions = "count(DISTINCT ic)" if fan_out else "coalesce(max(n), 0)"
    months = f"greatest(1, {AS_OF} - CAST(min(fecha_orden) AS DATE)) // 30"
    return f"""{tables("ordenes", "clientes", "interacciones_clientes")},
vista AS (
  SELECT c.id, c.uuid, c.nombre, c.segmento, c.industria, c.tamano_empresa, c.pais,
    count(DISTINCT o.id) AS total_ordenes, {money("sum(monto_total)")} AS valor_vida,
    {average("monto_total", 6)} AS valor_promedio_orden,
    max(fecha_orden) AS fecha_ultima_compra,
    {age("max(fecha_orden)")} AS dias_desde_ultima_compra,
    CAST(CAST(max(fecha_orden) AS DATE) - CAST(min(fecha_orden) AS DATE) AS INTEGER)
      AS dias_como_cliente,
    {fraction("count(DISTINCT o.id)", f"greatest(1, coalesce({months}, 1))")} AS ordenes_por_mes,
    count(DISTINCT date_trunc('month', fecha_orden)) AS meses_activos,
    {n_if("estado = 'cancelado'")} AS ordenes_canceladas,
    {n_if("estado_pago <> 'pagado'")} AS ordenes_sin_pago,
    CAST({interactions} AS BIGINT) AS total_interacciones,
    max(fecha_interaccion) AS fecha_ultima_interaccion
  FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id
  LEFT JOIN ({contacts}) i ON i.cliente_id = c.id
  WHERE c.activo GROUP BY ALL
)
"""


SQL["v_segmentacion_clientes"] = _segmentation(True) + "SELECT * FROM vista"
SQL["v_segmentacion_clientes_sin_fanout"] = _segmentation(False) + "SELECT * FROM vista"
SQL["d06_top_clientes"] = _segmentation(True) + """SELECT nombre, valor_vida, segmento FROM vista
ORDER BY valor_vida DESC NULLS LAST, id LIMIT 20"""


def _returns(fan_out: bool) -> str:
    lines = "items_orden i LEFT JOIN productos p ON p.id = i.producto_id"
    kept = "" if fan_out else "DISTINCT "
    return f"""{tables("ordenes", "items_orden", "productos", "devoluciones")},
lines AS (SELECT {kept}i.orden_id, p.categoria, p.subcategoria FROM {lines}),
per_day AS (SELECT {day("fecha_orden")} AS dia, count(DISTINCT id) AS n FROM ordenes GROUP BY 1)
SELECT {day("fecha_devolucion")} AS fecha_devolucion, categoria, subcategoria,
  count(DISTINCT d.id) AS cantidad_devoluciones,
  {money("sum(monto_reembolso)")} AS total_reembolsado,
  count(DISTINCT d.orden_id) AS ordenes_con_devolucion,
  {fraction("count(DISTINCT d.orden_id)", "any_value(per_day.n)", 6, "DECIMAL(19,6)")}
    AS tasa_devolucion_pct,
  {n_if("d.estado = 'aprobado'")} AS devoluciones_aprobadas,
  {n_if("d.estado = 'pendiente'")} AS devoluciones_pendientes,
  {n_if("d.estado = 'rechazado'")} AS devoluciones_rechazadas, motivo
FROM devoluciones d JOIN ordenes o ON o.id = d.orden_id
LEFT JOIN lines ON lines.orden_id = o.id
LEFT JOIN per_day ON per_day.dia = CAST(fecha_devolucion AS DATE)
WHERE {since("fecha_devolucion", "1 year")}
GROUP BY CAST(d.fecha_devolucion AS DATE), categoria, subcategoria, motivo"""


SQL["v_analisis_devoluciones"] = _returns(True)
SQL["v_analisis_devoluciones_sin_fanout"] = _returns(False)

_LATE = "count(DISTINCT orden_id) FILTER (WHERE p.fecha_pago > o.fecha_orden + INTERVAL '{} days')"
SQL["v_analisis_pagos"] = f"""{tables("ordenes", "pagos")}
SELECT {day("p.fecha_pago")} AS fecha_pago, p.metodo_pago, count(DISTINCT p.id) AS cantidad_pagos,
  count(DISTINCT orden_id) AS ordenes_pagadas, {money("sum(monto)")} AS total_cobrado,
  {average("monto", 6)} AS pago_promedio,
  {n_if("p.estado = 'completado'")} AS pagos_exitosos,
  {n_if("p.estado = 'fallido'")} AS pagos_fallidos,
  {n_if("p.estado = 'reembolsado'")} AS pagos_reembolsados,
  {_LATE.format(30)} AS pagos_atrasados_30d, {_LATE.format(60)} AS pagos_atrasados_60d
FROM pagos p JOIN ordenes o ON o.id = p.orden_id
WHERE {since("p.fecha_pago", "1 year")} GROUP BY 1, 2"""

_ZERO = "CAST(0 AS DECIMAL(15,2))"
_CAMPAIGN = f"""{tables("campanas", "campanas_clientes")},
vista AS (
  SELECT c.id, uuid, nombre, tipo_campana, canal, fecha_inicio, fecha_fin, presupuesto, gasto_real,
    {pct(cents("gasto_real"), cents("presupuesto"))} AS pct_presupuesto_usado,
    impresiones, clics, conversiones, ingresos_generados,
    {pct("clics", "impresiones")} AS ctr_pct, {pct("conversiones", "clics")} AS tasa_conversion_pct,
    CASE WHEN gasto_real > 0 THEN {fraction(cents("ingresos_generados"), cents("gasto_real"))}
      ELSE {_ZERO} END AS roi,
    CASE WHEN conversiones > 0 THEN {quotient("gasto_real", "conversiones")}
      ELSE {_ZERO} END AS costo_por_conversion,
    count(DISTINCT cliente_id) AS clientes_objetivo,
    count(DISTINCT cliente_id) FILTER (WHERE fecha_contacto IS NOT NULL) AS clientes_contactados,
    count(DISTINCT cliente_id) FILTER (WHERE convirtio) AS clientes_convertidos
  FROM campanas c LEFT JOIN campanas_clientes cc ON cc.campana_id = c.id
  WHERE {since("fecha_inicio", "2 years")} GROUP BY ALL
)
"""
SQL["v_performance_campanas"] = _CAMPAIGN + "SELECT * FROM vista"
SQL["d07_roi_campanas"] = _CAMPAIGN + f"""SELECT nombre, roi, canal FROM vista
WHERE {since("fecha_fin", "3 months")}"""


def _trend(fan_out: bool) -> str:
    if fan_out:
        rows = f"""SELECT o.*, cantidad * precio_costo AS costo FROM ordenes o
  LEFT JOIN items_orden i ON i.orden_id = o.id LEFT JOIN productos p ON p.id = i.producto_id
  WHERE o.{LIVE}"""
    else:
        rows = f"""SELECT o.*, (SELECT sum(cantidad * precio_costo) FROM items_orden i
    JOIN productos p ON p.id = i.producto_id WHERE i.orden_id = o.id) AS costo
  FROM ordenes o WHERE o.{LIVE}"""
    return f"""{tables("ordenes", "items_orden", "productos")},
joined AS ({rows}),
vista AS (
  SELECT {month("fecha_orden")} AS mes, CAST(year(fecha_orden) AS INTEGER) AS anio,
    CAST(month(fecha_orden) AS INTEGER) AS numero_mes, count(DISTINCT id) AS ordenes,
    count(DISTINCT cliente_id) AS clientes, {money("sum(monto_total)")} AS ingresos,
    {average("monto_total", 6)} AS valor_promedio_orden,
    {sum_if("monto_total", "estado = 'entregado'")} AS ingresos_entregados,
    {sum_if("monto_total", "estado = 'cancelado'")} AS ingresos_cancelados,
    {money("sum(monto_total) - coalesce(sum(costo), 0)")} AS ganancia_bruta
  FROM joined GROUP BY 1, 2, 3
)
"""


SQL["mv_tendencia_ventas_mensual"] = _trend(True) + "SELECT * FROM vista"
SQL["mv_tendencia_ventas_mensual_sin_fanout"] = _trend(False) + "SELECT * FROM vista"
SQL["d02_tendencia_2_anios"] = _trend(True) + f"""SELECT * FROM vista
WHERE anio >= year({AS_OF}) - 1"""

_RANKED = f"""{tables("ordenes", "items_orden", "productos")},
per_product AS (
  SELECT p.categoria, p.id, p.uuid, p.nombre, p.sku,
    count(DISTINCT i.orden_id) AS veces_pedido,
    CAST(sum(cantidad) AS BIGINT) AS cantidad_total_vendida,
    {money("sum(total_linea)")} AS ingresos_totales
  FROM productos p LEFT JOIN items_orden i ON i.producto_id = p.id
  WHERE p.activo GROUP BY ALL
),
vista AS (
  SELECT *, row_number() OVER (
    PARTITION BY categoria ORDER BY ingresos_totales DESC NULLS LAST, id) AS ranking_categoria
  FROM per_product
)
"""
SQL["mv_top_productos_por_categoria"] = _RANKED + "SELECT * FROM vista"
SQL["d03_top10_por_categoria"] = _RANKED + "SELECT * FROM vista WHERE ranking_categoria <= 10"

SQL["q01_kpis_mes"] = f"""{tables("ordenes")}
SELECT count(DISTINCT id) AS total_ordenes, count(DISTINCT cliente_id) AS clientes_unicos,
  {money("sum(monto_total)")} AS ingresos_totales,
  {average("monto_total", 6)} AS valor_promedio_orden,
  {sum_if("monto_total", "estado = 'entregado'")} AS ingresos_entregados,
  {sum_if("monto_total", UNPAID)} AS monto_impago,
  {n_if("estado_pago = 'pagado'")} AS ordenes_pagadas,
  {n_if("estado = 'cancelado'")} AS ordenes_canceladas
FROM ordenes WHERE {IN_MONTH}"""

SQL["q02_mes_vs_anterior"] = f"""{tables("ordenes")},
per_month AS (
  SELECT {month("fecha_orden")} AS mes, sum(monto_total) AS ingresos, count(*) AS ordenes
  FROM ordenes GROUP BY 1
),
pair AS (
  SELECT
    (SELECT ingresos FROM per_month WHERE mes = {month(AS_OF)}) AS i1,
    (SELECT ingresos FROM per_month WHERE mes = {month(AS_OF + " - INTERVAL '1 month'")}) AS i0,
    coalesce((SELECT ordenes FROM per_month WHERE mes = {month(AS_OF)}), 0) AS o1,
    coalesce((SELECT ordenes FROM per_month
      WHERE mes = {month(AS_OF + " - INTERVAL '1 month'")}), 0) AS o0
)
SELECT {money("i1")} AS ingresos_mes_actual, {money("i0")} AS ingresos_mes_anterior,
  {pct(cents("i1 - i0"), cents("i0"))} AS crecimiento_ingresos_pct,
  o1 AS ordenes_mes_actual, o0 AS ordenes_mes_anterior,
  {pct("o1 - o0", "o0")} AS crecimiento_ordenes_pct
FROM pair"""

SQL["q03_tendencia_semana"] = f"""{tables("ordenes")}
SELECT {day("fecha_orden")} AS fecha, dayname(any_value(fecha_orden)) AS nombre_dia,
  count(*) AS ordenes, {money("sum(monto_total)")} AS ingresos,
  {average("monto_total", 6)} AS valor_promedio_orden,
  {n_if("estado = 'entregado'")} AS entregadas, {n_if("estado_pago = 'pagado'")} AS ordenes_pagadas
FROM ordenes WHERE {since("fecha_orden", "7 days")} GROUP BY 1"""

SQL["q04_top_vendedores"] = f"""{tables("ordenes", "vendedores")}
SELECT nombre AS nombre_vendedor, equipo, territorio, cuota_mensual,
  count(DISTINCT o.id) AS ordenes, {money("sum(monto_total)")} AS ventas_totales,
  {pct(cents("sum(monto_total)"), cents("cuota_mensual"))} AS pct_cumplimiento_cuota,
  {fraction(cents("sum(monto_total)") + " * CAST(tasa_comision * 100 AS HUGEINT)", "1000000", 2,
            "DECIMAL(25,2)")} AS comision_ganada,
  count(DISTINCT cliente_id) AS clientes_unicos, max(fecha_orden) AS fecha_ultima_venta
FROM vendedores v LEFT JOIN ordenes o ON o.vendedor_id = v.id AND {LIVE} AND {IN_MONTH}
WHERE v.activo GROUP BY v.id, nombre, equipo, territorio, cuota_mensual, tasa_comision
ORDER BY sum(monto_total) DESC NULLS LAST, v.id LIMIT 10"""

SQL["q05_ytd_vs_anterior"] = f"""{tables("ordenes", "vendedores")},
per_year AS (
  SELECT vendedor_id, year(fecha_orden) AS anio, sum(monto_total) AS ventas
  FROM ordenes WHERE {LIVE} GROUP BY 1, 2
),
pair AS (
  SELECT v.id, v.nombre, a.ventas AS a, b.ventas AS b FROM vendedores v
  LEFT JOIN per_year a ON a.vendedor_id = v.id AND a.anio = year({AS_OF})
  LEFT JOIN per_year b ON b.vendedor_id = v.id AND b.anio = year({AS_OF}) - 1
  WHERE v.activo
)
SELECT nombre, {money("coalesce(a, 0)")} AS ventas_ytd_actual,
  {money("coalesce(b, 0)")} AS ventas_ytd_anterior,
  {pct(cents("coalesce(a, 0) - coalesce(b, 0)"), cents("coalesce(b, 1)"))} AS crecimiento_yoy_pct
FROM pair"""

SQL["q06_segmentacion"] = f"""{tables("ordenes", "clientes")}
SELECT segmento, count(DISTINCT c.id) AS total_clientes, count(DISTINCT o.id) AS total_ordenes,
  {money("sum(monto_total)")} AS ingresos_totales, {average("monto_total")} AS valor_promedio_orden,
  {quotient("sum(monto_total)", "count(DISTINCT c.id)")} AS ingresos_por_cliente,
  count(DISTINCT cliente_id) AS clientes_con_ordenes,
  {pct("count(DISTINCT cliente_id)", "count(DISTINCT c.id)")} AS pct_conversion
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id AND {LIVE}
WHERE c.activo GROUP BY segmento"""

SQL["q07_top_clientes"] = f"""{tables("ordenes", "clientes")}
SELECT c.id, nombre, segmento, industria, pais, count(DISTINCT o.id) AS total_ordenes,
  {money("sum(monto_total)")} AS valor_vida, {average("monto_total")} AS valor_promedio_orden,
  max(fecha_orden) AS fecha_ultima_compra, {age("max(fecha_orden)")} AS dias_desde_ultima_compra,
  {n_if("estado_pago = 'pagado'")} AS ordenes_pagadas, {n_if(UNPAID)} AS ordenes_sin_pago
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id AND {LIVE}
WHERE c.activo GROUP BY c.id, nombre, segmento, industria, pais
ORDER BY sum(monto_total) DESC NULLS LAST, c.id LIMIT 20"""

SQL["q08_clientes_riesgo"] = f"""{tables("ordenes", "clientes")}
SELECT c.id, nombre, segmento,
  CAST(coalesce(sum(monto_total) FILTER (WHERE {LIVE}), 0) AS DECIMAL(15,2)) AS valor_vida_total,
  max(fecha_orden) AS fecha_ultima_compra, {age("max(fecha_orden)")} AS dias_inactivo,
  count(DISTINCT o.id) AS ordenes_totales, {money("sum(monto_total)")} AS total_gastado
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id
WHERE c.activo GROUP BY c.id, nombre, segmento
HAVING max(fecha_orden) < {AS_OF} - INTERVAL '90 days'"""

SQL["q09_clientes_nuevos"] = f"""{tables("ordenes", "clientes")}
SELECT c.id, nombre, segmento, industria, tamano_empresa, fecha_adquisicion,
  count(DISTINCT o.id) AS ordenes_desde_adquisicion,
  {money("sum(monto_total)")} AS valor_compra_inicial, max(fecha_orden) AS fecha_primera_orden
FROM clientes c LEFT JOIN ordenes o ON o.cliente_id = c.id
WHERE {since("fecha_adquisicion", "30 days")}
GROUP BY c.id, nombre, segmento, industria, tamano_empresa, fecha_adquisicion"""

SQL["q10_top_productos"] = f"""{tables("ordenes", "items_orden", "productos")}
SELECT p.id, nombre, sku, categoria, marca, precio_lista, precio_costo,
  {pct(cents("precio_lista - precio_costo"), cents("precio_lista"))} AS margen_pct,
  count(DISTINCT orden_id) AS veces_pedido,
  CAST(sum(cantidad) AS BIGINT) AS cantidad_total_vendida,
  {money("sum(total_linea)")} AS ingresos_totales,
  {quotient("sum(total_linea)", "sum(cantidad)")} AS ingreso_promedio_por_unidad,
  {money("sum(cantidad * precio_costo)")} AS costo_total,
  {money("sum(total_linea) - sum(cantidad * precio_costo)")} AS ganancia_bruta,
  CAST(sum(cantidad_devuelta) AS BIGINT) AS total_devuelto
FROM productos p LEFT JOIN items_orden i ON i.producto_id = p.id WHERE activo
GROUP BY p.id, nombre, sku, categoria, marca, precio_lista, precio_costo
ORDER BY sum(total_linea) DESC NULLS LAST, p.id LIMIT 20"""

SQL["q11_productos_sin_ventas"] = f"""{tables("ordenes", "items_orden", "productos")}
SELECT id, nombre, sku, categoria, marca, precio_lista, fecha_lanzamiento,
  {age("fecha_lanzamiento")} AS dias_desde_lanzamiento, stock_actual,
  CASE WHEN {age("fecha_lanzamiento")} < 90 THEN 'Nuevo'
    WHEN fecha_descontinuacion IS NOT NULL THEN 'Descontinuado'
    ELSE 'Sin ventas' END AS razon_estado
FROM productos p
WHERE activo AND NOT EXISTS (SELECT 1 FROM items_orden i WHERE i.producto_id = p.id)"""

SQL["q12_categorias"] = f"""{tables("ordenes", "items_orden", "productos")}
SELECT categoria, count(DISTINCT p.id) AS cantidad_productos, count(DISTINCT orden_id) AS ordenes,
  CAST(sum(cantidad) AS BIGINT) AS unidades_vendidas, {money("sum(total_linea)")} AS ingresos,
  {average("precio_unitario")} AS precio_promedio,
  {money("sum(total_linea) - sum(cantidad * precio_costo)")} AS ganancia_bruta,
  {pct(cents("sum(total_linea)") + " - " + cents("sum(cantidad * precio_costo)"),
       cents("sum(total_linea)"))} AS margen_ganancia_pct,
  {pct("sum(cantidad_devuelta)", "sum(cantidad)")} AS tasa_devolucion_pct
FROM productos p LEFT JOIN items_orden i ON i.producto_id = p.id WHERE activo GROUP BY categoria"""

SQL["q13_estado_pagos"] = f"""{tables("ordenes")}
SELECT estado_pago, count(DISTINCT id) AS cantidad_ordenes,
  {money("sum(monto_total)")} AS monto_pendiente,
  {average("monto_total", 6)} AS monto_promedio_orden, max(fecha_orden) AS orden_mas_reciente
FROM ordenes WHERE {LIVE} AND {OPEN_PAYMENT} GROUP BY estado_pago"""

SQL["q14_ordenes_atrasadas"] = f"""{tables("ordenes", "clientes")}
SELECT o.id, o.uuid, nombre AS nombre_cliente, email, fecha_orden, monto_total, estado_pago,
  {age("fecha_orden")} AS dias_atraso,
  CASE WHEN {age("fecha_orden")} > 90 THEN 'Crítico' WHEN {age("fecha_orden")} > 60 THEN 'Urgente'
    ELSE 'Seguimiento' END AS prioridad_cobranza
FROM ordenes o JOIN clientes c ON c.id = o.cliente_id
WHERE {LIVE} AND {OPEN_PAYMENT} AND fecha_orden < {AS_OF} - INTERVAL '60 days'"""

SQL["q15_metodos_pago"] = f"""{tables("ordenes")}
SELECT metodo_pago, count(*) AS cantidad_transacciones,
  {money("sum(monto_total)")} AS monto_total, {average("monto_total")} AS monto_promedio,
  {n_if("estado_pago = 'pagado'")} AS pagos_exitosos, {n_if(UNPAID)} AS pagos_pendientes,
  {pct(n_if("estado_pago = 'pagado'"), "count(*)")} AS tasa_exito_pct
FROM ordenes o WHERE {LIVE} GROUP BY metodo_pago"""

SQL["q16_resumen_devoluciones"] = f"""{tables("devoluciones")}
SELECT count(DISTINCT id) AS total_devoluciones, count(DISTINCT orden_id) AS ordenes_con_devolucion,
  {money("sum(monto_reembolso)")} AS total_reembolsado,
  {average("monto_reembolso")} AS reembolso_promedio,
  {n_if("estado = 'aprobado'")} AS devoluciones_aprobadas,
  {n_if("estado = 'pendiente'")} AS devoluciones_pendientes,
  {n_if("estado = 'rechazado'")} AS devoluciones_rechazadas,
  {pct(n_if("estado = 'aprobado'"), "count(*)")} AS tasa_aprobacion_pct
FROM devoluciones"""

SQL["q17_motivos_devolucion"] = f"""{tables("devoluciones")}
SELECT motivo, count(*) AS cantidad_devoluciones,
  {money("sum(monto_reembolso)")} AS total_reembolsado,
  {average("monto_reembolso")} AS reembolso_promedio,
  {n_if("estado = 'aprobado'")} AS aprobadas,
  {pct("count(*)", "(SELECT count(*) FROM devoluciones)")} AS pct_del_total
FROM devoluciones WHERE {since("fecha_devolucion", "1 year")}
GROUP BY motivo ORDER BY count(*) DESC, motivo LIMIT 10"""

SQL["q18_tasa_devolucion"] = f"""{tables("ordenes", "items_orden", "productos")}
SELECT categoria, nombre, sku, count(DISTINCT orden_id) AS veces_pedido,
  CAST(sum(cantidad) AS BIGINT) AS total_vendido,
  CAST(sum(cantidad_devuelta) AS BIGINT) AS total_devuelto,
  {pct("sum(cantidad_devuelta)", "sum(cantidad)")} AS tasa_devolucion_pct
FROM productos p JOIN items_orden i ON i.producto_id = p.id
GROUP BY p.id, categoria, nombre, sku
HAVING sum(cantidad) >= 10 AND sum(cantidad_devuelta) > 0"""

SQL["q19_campanas_activas"] = f"""{tables("campanas")},
filled AS (
  SELECT nombre, tipo_campana, canal, fecha_inicio, fecha_fin, presupuesto AS p, impresiones AS i,
    clics AS c, ifnull(gasto_real, 0) AS gasto, ifnull(ingresos_generados, 0) AS ingreso,
    ifnull(conversiones, 0) AS conv
  FROM campanas WHERE estado = 'activa' OR {since("fecha_fin", "30 days")}
)
SELECT nombre, tipo_campana, canal, fecha_inicio, fecha_fin,
  CAST(ifnull(p, 0) AS DECIMAL(15,2)) AS presupuesto, CAST(gasto AS DECIMAL(15,2)) AS gasto_real,
  {pct(cents("gasto"), cents("ifnull(p, 1)"))} AS pct_presupuesto_usado,
  ifnull(i, 0) AS impresiones, ifnull(c, 0) AS clics,
  {pct("ifnull(c, 0)", "ifnull(i, 1)")} AS ctr_pct, conv AS conversiones,
  {pct("conv", "ifnull(c, 1)")} AS tasa_conversion_pct,
  CAST(ingreso AS DECIMAL(15,2)) AS ingresos_generados,
  CASE WHEN gasto > 0 THEN {fraction(cents("ingreso"), cents("gasto"))} ELSE {_ZERO} END AS roi
FROM filled"""

SQL["q20_tendencia_mensual"] = f"""{tables("ordenes", "items_orden", "productos")}
SELECT {month("fecha_orden")} AS mes, count(*) AS cantidad_ordenes,
  count(DISTINCT cliente_id) AS clientes_unicos, {money("sum(monto_total)")} AS ingresos,
  {average("monto_total")} AS valor_promedio_orden,
  {money("sum(monto_total) - sum(cantidad * precio_costo)")} AS ganancia_bruta,
  {n_if("o.estado = 'entregado'")} AS ordenes_entregadas,
  {n_if("o.estado = 'cancelado'")} AS ordenes_canceladas
FROM ordenes o LEFT JOIN items_orden i ON i.orden_id = o.id
LEFT JOIN productos p ON p.id = i.producto_id
WHERE {since("fecha_orden", "12 months")} AND o.{LIVE} GROUP BY 1"""

SQL["q22_reporte_semanal"] = f"""{tables("ordenes")}
SELECT 'Semana' AS periodo, CAST(max(fecha_orden) AS DATE) - 6 AS fecha_inicio,
  {day("max(fecha_orden)")} AS fecha_fin, count(*) AS ordenes,
  {money("sum(monto_total)")} AS ingresos, count(DISTINCT cliente_id) AS clientes_activos,
  {n_if("estado = 'cancelado'")} AS ordenes_canceladas,
  {pct(n_if("estado_pago = 'pagado'"), "count(*)")} AS pct_cobrado
FROM ordenes WHERE {since("fecha_orden", "7 days")}"""

SQL["q23_export_hechos"] = f"""{tables("ordenes", "items_orden", "clientes", "vendedores")}
SELECT o.id AS orden_id, o.uuid AS orden_uuid, fecha_orden, monto_total, estado, estado_pago,
  c.id AS cliente_id, segmento, industria, tamano_empresa, v.id AS vendedor_id,
  v.nombre AS nombre_vendedor, equipo, producto_id, cantidad, total_linea
FROM ordenes o JOIN clientes c ON c.id = o.cliente_id
LEFT JOIN vendedores v ON v.id = o.vendedor_id LEFT JOIN items_orden i ON i.orden_id = o.id
WHERE {since("fecha_orden", "12 months")}"""

SQL["d04_ventas_mes"] = f"""{tables("ordenes")}
SELECT {money("sum(monto_total)")} AS ingresos_mes FROM ordenes WHERE {FROM_MONTH}"""

SQL["d08_kpis_30d"] = f"""{tables("ordenes")}
SELECT count(*) AS ordenes_30d, {money("sum(monto_total)")} AS ingresos_30d,
  count(DISTINCT cliente_id) AS clientes_30d, {average("monto_total", 6)} AS promedio_30d
FROM ordenes WHERE {since("fecha_orden", "30 days")}"""

SQL["d09_mensual_cte"] = f"""{tables("ordenes")}
SELECT {month("fecha_orden")} AS mes, {money("sum(monto_total)")} AS ingresos
FROM ordenes GROUP BY 1 HAVING {since(month("fecha_orden"), "12 months")}"""
