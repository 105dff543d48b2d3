"""Checking SQL for the parametrised analyses."""

from __future__ import annotations

from tablero.oracle.kit import LIVE, cents, fraction, money, month, pct, since, tables

SQL: dict[str, str] = {}

SQL["fn_calcular_arr"] = f"""{tables("ordenes", "clientes")},
monthly AS (
  SELECT segmento, {month("fecha_orden")} AS mes, sum(monto_total) AS ventas
  FROM ordenes o JOIN clientes c ON c.id = o.cliente_id
  WHERE {LIVE} AND {since("fecha_orden", "12 months")} GROUP BY ALL
)
SELECT segmento,
  {fraction(cents("sum(ventas)"), "100 * count(*)", 2, "DECIMAL(25,2)")} AS ingreso_mensual,
  {fraction("12 * " + cents("sum(ventas)"), "100 * count(*)", 2, "DECIMAL(25,2)")} AS ingreso_anual
FROM monthly GROUP BY segmento"""
SQL["q24_arr"] = SQL["fn_calcular_arr"]

_BUYERS = f"SELECT cliente_id FROM ordenes WHERE {LIVE} AND {{}}"
SQL["fn_calcular_churn"] = f"""{tables("ordenes", "clientes")},
active AS (SELECT * FROM clientes WHERE id IN ({_BUYERS.format(since("fecha_orden", "90 days"))})),
flagged AS (
  SELECT segmento, id NOT IN ({_BUYERS.format(since("fecha_orden", "30 days"))}) AS perdido
  FROM active
)
SELECT segmento, count(*) AS total_clientes_inicio_periodo,
  count(*) FILTER (WHERE perdido) AS clientes_perdidos,
  {pct("count(*) FILTER (WHERE perdido)", "count(*)")} AS tasa_churn_pct
FROM flagged GROUP BY segmento"""
SQL["q25_churn"] = SQL["fn_calcular_churn"]


def _forecast(name: str) -> str:
    top = ("(sy * (n * sxx - sx * sx) + (n * sxy - sx * sy) * (n * (ultimo + h) - sx))")
    value = fraction(top, "100 * n * (n * sxx - sx * sx)", 2, "DECIMAL(25,2)")
    return f"""{tables("ordenes")},
monthly AS (
  SELECT {month("fecha_orden")} AS mes, {cents("sum(monto_total)")} AS y,
    row_number() OVER (ORDER BY {month("fecha_orden")}) AS x
  FROM ordenes WHERE {LIVE} AND {since("fecha_orden", "12 months")} GROUP BY 1
),
sums AS (
  SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy,
    max(x) AS ultimo, max(mes) AS ultimo_mes FROM monthly
)
SELECT CAST(ultimo_mes + to_months(CAST(h AS INTEGER)) AS DATE) AS mes_pronostico,
  greatest(CAST(0 AS DECIMAL(25,2)), {value}) AS {name}
FROM sums, range(1, 4) AS g(h) WHERE n > 1"""


SQL["fn_pronostico_ventas"] = _forecast("ingreso_pronosticado")
SQL["q21_pronostico"] = _forecast("ingresos_pronosticados")


def _cohorts(metric: str, literal: bool = False) -> str:
    first = month("fecha_orden") if literal else (
        f"min({month('fecha_orden')}) OVER (PARTITION BY cliente_id)"
    )
    return f"""{tables("ordenes", "clientes")},
sold AS (
  SELECT o.id, cliente_id, monto_total, {month("fecha_orden")} AS mes, {first} AS mes_cohorte
  FROM ordenes o WHERE {LIVE} AND cliente_id IN (SELECT id FROM clientes)
)
SELECT mes_cohorte,
  CAST(date_diff('month', mes_cohorte, mes) AS INTEGER) AS meses_desde_primera_orden,
  {money(metric)} AS valor_metrica, count(DISTINCT cliente_id) AS cantidad_clientes
FROM sold GROUP BY 1, 2"""


SQL["fn_analisis_cohortes"] = _cohorts("sum(monto_total)")
SQL["fn_analisis_cohortes_ordenes"] = _cohorts("count(DISTINCT id)")
SQL["fn_analisis_cohortes_retencion"] = _cohorts("count(DISTINCT cliente_id)")
SQL["fn_analisis_cohortes_literal"] = _cohorts("sum(monto_total)", literal=True)
SQL["q26_cohortes"] = SQL["fn_analisis_cohortes"]
