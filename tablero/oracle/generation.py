"""Checking SQL for the generators: the same draws, spelled out in the other dialect."""

from __future__ import annotations

from tablero import schemas
from tablero.functions.draws import draw_sql, words_sql
from tablero.operators import generation as g
from tablero.oracle.kit import AS_OF, tables

SQL: dict[str, str] = {}
_SPAN = 4294967296


def _u(purpose: str, i: int, key: str = "id") -> str:
    return f"({draw_sql(purpose, 0, i, words_sql(purpose, 0, key))})"


def _scaled(draw: str, top: int | str) -> str:
    return f"(({draw} * {top} + {_SPAN // 2}) // {_SPAN})"


def _pick(values: list[str], index: str) -> str:
    words = ", ".join(f"'{v}'" for v in values)
    return f"([{words}])[{index} + 1]"


def _choice(draw: str, values: list[str]) -> str:
    return _pick(values, _scaled(draw, len(values) - 1))


def _above(draw: str, share: float) -> str:
    return f"({draw} > {int(share * _SPAN)})"


def _amount(draw: str, low: int, span: int, digits: int, kind: str) -> str:
    unit = f"CAST('{10 ** -digits:.{digits}f}' AS DECIMAL({digits + 1},{digits}))"
    return f"CAST(CAST({low} + {_scaled(draw, span)} AS DECIMAL(20,0)) * {unit} AS {kind})"


def _place(high: str, low: str, n: str) -> str:
    return f"(({high} * 1048576 + {low} // 4096) % {n})"


def _uuid(purpose: str) -> str:
    return f"md5('0|{purpose}|uuid|' || id)"


def _pad(value: str, width: int) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest({width}, length({text})) AS INTEGER), '0')"


def _person(p: str) -> str:
    given = f"CASE WHEN {_above(_u(p, 0), 0.5)} THEN {_choice(_u(p, 1), g.NOMBRES_M)} " \
            f"ELSE {_choice(_u(p, 1), g.NOMBRES_F)} END"
    return f"{given} || ' ' || {_choice(_u(p, 2), g.APELLIDOS)}"


def _email(p: str) -> str:
    domain = _pick(g.DOMINIOS, f"least({_scaled(_u(p, 3), 5)}, 4)")
    return f"lower(translate(nombre, ' óé', '.oe') || '.' || id || '@' || {domain})"


def _phone(p: str) -> str:
    area = _pick(g.AREAS, f"least({_scaled(_u(p, 4), 3)}, 2)")
    return f"'+54 ' || {area} || ' ' || {_pad(_scaled(_u(p, 5), 99999999), 8)}"


def _ago(days: str) -> str:
    return f"({AS_OF} - CAST({days} AS INTEGER))"


_C = "clientes"
_CLIENTS = f"""WITH ids AS (SELECT c_custkey + 1 AS id FROM customer),
named AS (SELECT id, {_person(_C)} AS nombre,
  {_choice(_u(_C, 6), schemas.SEGMENTOS)} AS segmento FROM ids),
made AS (
  SELECT id, {_uuid(_C)} AS uuid, nombre, {_email(_C)} AS email, {_phone(_C)} AS telefono,
    segmento, {_choice(_u(_C, 7), g.INDUSTRIAS)} AS industria,
    {_choice(_u(_C, 8), schemas.TAMANOS_EMPRESA)} AS tamano_empresa,
    {_choice(_u(_C, 9), g.PAISES)} AS pais, {_choice(_u(_C, 10), g.PROVINCIAS)} AS provincia,
    {_choice(_u(_C, 11), g.CIUDADES)} AS ciudad,
    {_pad(_scaled(_u(_C, 12), 9999), 4)} AS codigo_postal,
    {_amount(_u(_C, 13), 1000000, 99000000, 2, "DECIMAL(15,2)")} AS limite_credito,
    CAST(0 AS DECIMAL(15,2)) AS valor_vida_total,
    CAST({_ago(_scaled(_u(_C, 14), 365))} AS TIMESTAMP) AS fecha_adquisicion,
    segmento <> 'inactivo' AS activo
  FROM named
)
"""
SQL["gen_clientes"] = _CLIENTS + "SELECT * FROM made"
SQL["gen_nombre"] = _CLIENTS + "SELECT id, nombre FROM made"
SQL["gen_email"] = _CLIENTS + "SELECT id, nombre, email FROM made"
SQL["gen_telefono"] = _CLIENTS + "SELECT id, telefono FROM made"

_INDEXED = " UNION ALL ".join(
    f"SELECT '{gender}' AS g, unnest({words!r}) AS v, unnest(range(1, 11)) AS n"
    for gender, words in (("M", g.INDICE_M), ("F", g.INDICE_F))
)
SQL["gen_nombre_por_indices"] = f"""WITH asked AS (
  SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS genero,
    CAST(c_custkey % 12 AS INTEGER) AS i_nombre, c_nationkey % 11 + 1 AS i_apellido FROM customer
),
firsts AS ({_INDEXED}),
lasts AS (SELECT unnest({g.INDICE_APELLIDOS!r}) AS v, unnest(range(1, 11)) AS n)
SELECT id, genero, i_nombre, i_apellido, f.v AS nombre, l.v AS apellido,
  f.v || ' ' || l.v AS nombre_completo
FROM asked JOIN firsts f ON f.g = genero AND f.n = i_nombre JOIN lasts l ON l.n = i_apellido"""

_P = "productos"
_SUB = " ".join(
    f"WHEN '{category}' THEN {_choice(_u(_P, 1), subs)}"
    for category, subs in g.SUBCATEGORIAS.items()
)
SQL["gen_productos"] = f"""WITH ids AS (SELECT p_partkey + 1 AS id FROM part),
drawn AS (SELECT id, {_choice(_u(_P, 0), g.CATEGORIAS)} AS categoria,
  {_choice(_u(_P, 2), g.MARCAS)} AS marca FROM ids),
named AS (SELECT *, CASE categoria {_SUB} ELSE 'Otro' END AS subcategoria FROM drawn)
SELECT id, {_uuid(_P)} AS uuid, marca || ' ' || subcategoria || ' ' || (id - 1) AS nombre,
  'SKU-' || {_pad("id - 1", 6)} AS sku,
  'Producto de alta calidad: ' || subcategoria || ' de ' || marca AS descripcion,
  categoria, subcategoria, marca,
  {_amount(_u(_P, 3), 10000, 990000, 2, "DECIMAL(10,2)")} AS precio_lista,
  {_amount(_u(_P, 4), 5000, 495000, 2, "DECIMAL(10,2)")} AS precio_costo,
  CAST({_scaled(_u(_P, 5), 1000)} AS INTEGER) AS stock_actual,
  CAST(CASE WHEN {_above(_u(_P, 6), 0.7)} THEN {_scaled(_u(_P, 7), 50)} ELSE 0 END + 10 AS INTEGER)
    AS stock_minimo,
  {_amount(_u(_P, 8), 10, 9990, 2, "DECIMAL(8,2)")} AS peso_kg,
  {_amount(_u(_P, 9), 1, 9999, 3, "DECIMAL(8,3)")} AS volumen_m3,
  {_above(_u(_P, 10), 0.7)} AS es_digital,
  {_ago(_scaled(_u(_P, 11), 730))} AS fecha_lanzamiento, {_above(_u(_P, 12), 0.15)} AS activo
FROM named"""

_V = "vendedores"
_BOSS = _place(_u(_V, 9), _u(_V, 10), "(id - 1)") + " + 1"
SQL["gen_vendedores"] = f"""WITH ids AS (SELECT s_suppkey + 1 AS id FROM supplier),
named AS (SELECT id, {_person(_V)} AS nombre FROM ids)
SELECT id, {_uuid(_V)} AS uuid, nombre, {_email(_V)} AS email, {_phone(_V)} AS telefono,
  {_choice(_u(_V, 6), g.EQUIPOS)} AS equipo, {_choice(_u(_V, 7), g.TERRITORIOS)} AS territorio,
  CASE WHEN id > 1 AND {_above(_u(_V, 8), 0.7)} THEN {_BOSS} END AS gerente_id,
  {_amount(_u(_V, 11), 500, 1000, 2, "DECIMAL(5,2)")} AS tasa_comision,
  {_amount(_u(_V, 12), 5000000, 20000000, 2, "DECIMAL(15,2)")} AS cuota_mensual,
  {_above(_u(_V, 13), 0.1)} AS activo, {_ago(_scaled(_u(_V, 14), 1095))} AS fecha_contratacion
FROM named"""

# Cumulative bounds of the order states, written out: .05, .145, .27325, .4186, .59302.
_BOUNDS = [("cancelado", 0.05), ("pendiente", 0.145), ("confirmado", 0.27325),
           ("procesando", 0.4186), ("enviado", 0.59302)]
_O = "ordenes"
_STATE = "CASE " + " ".join(
    f"WHEN NOT {_above(_u(_O, 0), bound)} THEN '{state}'" for state, bound in _BOUNDS
) + " ELSE 'entregado' END"


def _orders(n: str) -> str:
    """Orders with the given ids; clients and reps are drawn from the mapped tables."""
    return f"""ids AS ({n}),
active_c AS (SELECT id AS cid, row_number() OVER (ORDER BY id) - 1 AS n FROM clientes WHERE activo),
active_v AS (SELECT id AS vid, row_number() OVER (ORDER BY id) - 1 AS n FROM vendedores
  WHERE activo),
drawn AS (
  SELECT id, {_STATE} AS estado,
    {_place(_u(_O, 9), _u(_O, 10), "(SELECT count(*) FROM active_c)")} AS pc,
    {_place(_u(_O, 11), _u(_O, 12), "(SELECT count(*) FROM active_v)")} AS pv
  FROM ids
),
made AS (
  SELECT id, {_uuid(_O)} AS uuid, cid AS cliente_id,
    CASE WHEN {_above(_u(_O, 8), 0.2)} THEN vid END AS vendedor_id,
    CAST({_ago(_scaled(_u(_O, 1), 365))} AS TIMESTAMP) AS fecha_orden,
    {_ago(_scaled(_u(_O, 1), 365))} + 5 AS fecha_entrega_prometida,
    CASE WHEN {_above(_u(_O, 6), 0.7)} THEN {_amount(_u(_O, 7), 500, 2000, 2, "DECIMAL(5,2)")}
      ELSE CAST(0 AS DECIMAL(5,2)) END AS porcentaje_descuento,
    {_amount(_u(_O, 4), 5000, 45000, 2, "DECIMAL(15,2)")} AS monto_impuesto,
    {_amount(_u(_O, 5), 1000, 9000, 2, "DECIMAL(15,2)")} AS costo_envio,
    {_choice(_u(_O, 3), schemas.METODOS_PAGO)} AS metodo_pago,
    CASE estado WHEN 'entregado' THEN {_choice(_u(_O, 2), schemas.ESTADOS_PAGO_ORDEN)}
      WHEN 'cancelado' THEN 'reembolsado' ELSE 'pendiente' END AS estado_pago, estado
  FROM drawn JOIN active_c ON active_c.n = pc JOIN active_v ON active_v.n = pv
)"""


_FROM_ORDERS = "SELECT o_orderkey + 1 AS id FROM orders"
SQL["gen_ordenes"] = f"""{tables("clientes", "vendedores")},
{_orders(_FROM_ORDERS)}
SELECT * FROM made"""

_K = "((orden_id - 1) * 8 + linea)"
_ITEMS = f"""active_p AS (
  SELECT id AS pid, precio_lista, row_number() OVER (ORDER BY id) - 1 AS n
  FROM productos WHERE activo
),
opened AS (
  SELECT id AS orden_id, estado, unnest(range(1, {_scaled(_u("lineas", 0), 7)} + 2)) AS linea
  FROM made
),
placed AS (
  SELECT *, {_place(_u("items", 0, _K), _u("items", 1, _K), "(SELECT count(*) FROM active_p)")}
    AS pp
  FROM opened
),
priced AS (
  SELECT (orden_id - 1) * 8 + linea AS id, orden_id, pid AS producto_id,
    CAST({_scaled(_u("items", 2, _K), 10)} + 1 AS INTEGER) AS cantidad,
    precio_lista AS precio_unitario,
    CASE WHEN {_above(_u("items", 3, _K), 0.7)}
      THEN {_amount(_u("items", 4, _K), 0, 2000, 2, "DECIMAL(5,2)")}
      ELSE CAST(0 AS DECIMAL(5,2)) END AS porcentaje_descuento,
    estado IN ('entregado', 'enviado') AS completado
  FROM placed JOIN active_p ON active_p.n = pp
),
lines AS (
  SELECT *, CAST(cantidad * precio_unitario * (100 - porcentaje_descuento)
    * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS total_linea,
    0 AS cantidad_devuelta
  FROM priced
)"""
SQL["gen_items"] = f"""{tables("clientes", "vendedores", "productos")},
{_orders(_FROM_ORDERS)},
{_ITEMS}
SELECT * FROM lines"""

_G = "pagos"
SQL["gen_pagos"] = f"""{tables("clientes", "vendedores", "productos")},
{_orders(_FROM_ORDERS)},
{_ITEMS},
totals AS (
  SELECT made.id, estado_pago, CAST(coalesce(sum(total_linea), 0) + any_value(monto_impuesto)
    + any_value(costo_envio) AS DECIMAL(15,2)) AS monto_total
  FROM made LEFT JOIN lines ON lines.orden_id = made.id GROUP BY made.id, estado_pago
)
SELECT id, {_uuid(_G)} AS uuid, id AS orden_id,
  CASE WHEN {_above(_u(_G, 0), 0.3)} THEN monto_total
    ELSE CAST(monto_total * {_amount(_u(_G, 1), 300000, 700000, 6, "DECIMAL(7,6)")}
      AS DECIMAL(15,2)) END AS monto,
  CAST({_ago(_scaled(_u(_G, 3), 365))} AS TIMESTAMP) AS fecha_pago,
  {_choice(_u(_G, 2), schemas.METODOS_PAGO)} AS metodo_pago,
  'REF-' || {_pad(_scaled(_u(_G, 4), 999999), 8)} AS numero_referencia, 'completado' AS estado
FROM totals WHERE estado_pago IN ('pagado', 'parcial', 'vencido') AND monto_total > 0"""

_COUNTED = "SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS id"
SQL["gen_all"] = f"""WITH ids AS ({_COUNTED}),
drawn AS (SELECT id, {_STATE} AS estado FROM ids),
paid AS (SELECT id FROM drawn WHERE estado = 'entregado'
  AND {_choice(_u(_O, 2), schemas.ESTADOS_PAGO_ORDEN)} IN ('pagado', 'parcial', 'vencido'))
SELECT 'CLIENTES' AS paso, (SELECT count(*) FROM customer) AS registros
UNION ALL SELECT 'PRODUCTOS', (SELECT count(*) FROM part)
UNION ALL SELECT 'VENDEDORES', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'ÓRDENES E ÍTEMS', (SELECT CAST(sum({_scaled(_u("lineas", 0), 7)} + 2) AS BIGINT)
  FROM ids)
UNION ALL SELECT 'PAGOS', (SELECT count(*) FROM paid)"""
