"""The sales model seen through the given retail Parquet tables.

Every column is one SQL expression that Spark and the checking engine parse alike; the
oracle reads the same text. Columns that are not listed here are NULL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablero import schemas
from tablero.functions import periods
from tablero.session import split_hot_keys

AS_OF = dt.date(2001, 7, 31)

# Types of the given files, stated so that no read has to infer them.
RAW = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def _pick(values: list[str] | str, index: str) -> str:
    text = values if isinstance(values, str) else ",".join(values)
    return f"split_part('{text}', ',', CAST({index} AS INT))"


def _fl(value: str) -> str:
    return f"CAST(floor({value}) AS BIGINT)"


def _str(value: str) -> str:
    return f"CAST({value} AS STRING)"


def _money(value: str) -> str:
    return f"CAST({value} AS DECIMAL(15,2))"


_TODAY = f"DATE '{AS_OF}'"
_CENT = "CAST(0.01 AS DECIMAL(3,2))"

CLIENTES = {
    "id": "c_custkey",
    "uuid": f"md5('cli-' || {_str('c_custkey')})",
    "nombre": "c_name",
    "email": f"'c' || {_str('c_custkey')} || '@empresa.com'",
    "segmento": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'premium' WHEN 'HOUSEHOLD' THEN "
    "'estandar' WHEN 'FURNITURE' THEN 'prueba' WHEN 'BUILDING' THEN 'vip' ELSE 'inactivo' END",
    "industria": _pick("Tecnología,Finanzas,Salud,Comercio,Manufactura,Educación,Consultoría,"
                       "Energía", "c_custkey % 8 + 1"),
    "tamano_empresa": _pick(schemas.TAMANOS_EMPRESA, f"{_fl('c_custkey / 8')} % 5 + 1"),
    "pais": "n_name",
    "provincia": "r_name",
    "limite_credito": _money("c_acctbal"),
    "fecha_adquisicion": f"CAST({_TODAY} - CAST(c_custkey % 365 AS INT) AS {{ts}})",
    "activo": "c_mktsegment <> 'AUTOMOBILE'",
}

PRODUCTOS = {
    "id": "p_partkey",
    "uuid": f"md5('prod-' || {_str('p_partkey')})",
    "nombre": "p_name",
    "sku": f"'SKU-' || lpad({_str('p_partkey')}, "
    f"CAST(greatest(6, length({_str('p_partkey')})) AS INT), '0')",
    "categoria": "p_type",
    "subcategoria": "split_part(p_name, ' ', 2)",
    "marca": "p_brand",
    "precio_lista": "CAST(p_retailprice AS DECIMAL(10,2))",
    "precio_costo": "CAST(p_retailprice * 0.5 AS DECIMAL(10,2))",
    "stock_actual": "p_size * 20",
    "fecha_lanzamiento": f"{_TODAY} - CAST(p_partkey % 730 AS INT)",
    "fecha_descontinuacion": "CASE WHEN p_partkey % 50 = 0 THEN DATE '2001-07-01' END",
    "activo": "p_partkey % 20 >= 3",
}

VENDEDORES = {
    "id": "s_suppkey",
    "uuid": f"md5('ven-' || {_str('s_suppkey')})",
    "nombre": "s_name",
    "equipo": _pick("Empresas,PyMEs,Startups,Estratégico", "s_suppkey % 4 + 1"),
    "territorio": _pick("Norte,Sur,Este,Oeste,Centro", "s_suppkey % 5 + 1"),
    "gerente_id": f"CASE WHEN s_suppkey % 10 >= 7 THEN {_fl('s_suppkey / 2')} END",
    "tasa_comision": "CAST(5 + s_suppkey % 10 AS DECIMAL(5,2))",
    "cuota_mensual": _money("50000 + (s_suppkey % 100) * 2000"),
    "activo": "s_suppkey % 10 <> 0",
}

_ORDER_MOMENT = "o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND"
_ORDER_STATE = (
    "CASE WHEN o_orderkey % 100 < 5 THEN 'cancelado' WHEN o_orderkey % 100 < 15 THEN 'pendiente' "
    "WHEN o_orderkey % 100 < 28 THEN 'confirmado' WHEN o_orderkey % 100 < 42 THEN 'procesando' "
    "WHEN o_orderkey % 100 < 58 THEN 'enviado' WHEN o_orderkey % 100 < 60 THEN 'devuelto' "
    "ELSE 'entregado' END"
)
_ORDER_PAYMENT = (
    "CASE WHEN o_orderkey % 100 < 5 THEN 'reembolsado' WHEN o_orderkey % 100 >= 60 THEN "
    + _pick(schemas.ESTADOS_PAGO_ORDEN, f"{_fl('o_orderkey / 100')} % 5 + 1")
    + " ELSE 'pendiente' END"
)

ORDENES = {
    "id": "o_orderkey",
    "uuid": f"md5('ord-' || {_str('o_orderkey')})",
    "cliente_id": "o_custkey + CASE WHEN o_custkey % 20 = 0 THEN 1 ELSE 0 END",
    "vendedor_id": f"CASE WHEN o_orderkey % 5 <> 0 THEN {_fl('o_orderkey / 7')} % {{reps}} END",
    "fecha_orden": _ORDER_MOMENT,
    "fecha_entrega_prometida": f"CAST({_ORDER_MOMENT} AS DATE) + 5",
    "subtotal": _money(f"{_money('o_totalprice')} - (50 + o_orderkey % 450) - "
                       "(10 + o_orderkey % 90)"),
    "monto_descuento": _money("0"),
    "monto_impuesto": _money("50 + o_orderkey % 450"),
    "costo_envio": _money("10 + o_orderkey % 90"),
    "monto_total": _money("o_totalprice"),
    "metodo_pago": _pick(schemas.METODOS_PAGO, f"{_fl('o_orderkey / 3')} % 4 + 1"),
    "estado_pago": _ORDER_PAYMENT,
    "estado": _ORDER_STATE,
}

_PRICE = f"CAST({_fl('l_extendedprice * 100 / l_quantity')} * {_CENT} AS DECIMAL(10,2))"
_DISCOUNT = "CAST(l_discount * 100 AS DECIMAL(5,2))"
ITEMS = {
    "id": "{line_id}",
    "orden_id": "l_orderkey",
    # Every 97th product is never sold: its lines belong to the next one.
    "producto_id": "l_partkey + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END",
    "cantidad": "CAST(l_quantity AS INT)",
    "precio_unitario": _PRICE,
    "porcentaje_descuento": _DISCOUNT,
    "total_linea": _money(f"CAST(l_quantity AS INT) * {_PRICE} * (100 - {_DISCOUNT}) * {_CENT}"),
    "cantidad_devuelta": "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) % 4 "
    "ELSE 0 END",
}

PAGOS_FILTER = "estado_pago IN ('pagado', 'parcial', 'vencido') AND monto_total > 0"
PAGOS = {
    "id": "id",
    "uuid": f"md5('pag-' || {_str('id')})",
    "orden_id": "id",
    "monto": "CASE WHEN id % 10 < 7 THEN monto_total ELSE "
    + _money(f"monto_total * (30 + id % 70) * {_CENT}") + " END",
    "fecha_pago": "fecha_orden + (id % 90) * INTERVAL '1' DAY",
    "metodo_pago": "metodo_pago",
    "estado": "CASE id % 50 WHEN 0 THEN 'fallido' WHEN 1 THEN 'reembolsado' "
    "ELSE 'completado' END",
}

RETURNED = "l_returnflag = 'R'"
DEVOLUCIONES = {
    "id": "id",
    "uuid": f"md5('dev-' || {_str('id')})",
    "orden_id": "id",
    "fecha_devolucion": "fecha_orden + (id % 60) * INTERVAL '1' DAY",
    "motivo": _pick("defectuoso,producto_incorrecto,tarde,no_deseado,otro",
                    f"{_fl('id / 11')} % 5 + 1"),
    "monto_reembolso": _money("monto_total * CAST(0.25 AS DECIMAL(3,2))"),
    "estado": _pick("aprobado,pendiente,rechazado,reembolsado", "id % 4 + 1"),
}

INTERACCIONES = {
    "id": "event_id",
    "cliente_id": "user_id",
    "tipo_interaccion": "CASE event_type WHEN 'view' THEN 'llamada' WHEN 'click' THEN 'email' "
    "WHEN 'purchase' THEN 'demo' WHEN 'signup' THEN 'reunion' ELSE 'soporte' END",
    "fecha_interaccion": "ts",
}

CAMPANAS = {
    "id": "CAST(n_nationkey AS BIGINT)",
    "uuid": f"md5('cam-' || {_str('n_nationkey')})",
    "nombre": "n_name",
    "tipo_campana": _pick(schemas.TIPOS_CAMPANA, "n_nationkey % 5 + 1"),
    "canal": _pick(schemas.CANALES, "n_nationkey % 6 + 1"),
    "fecha_inicio": "DATE '2001-07-01' - n_nationkey * 40",
    "fecha_fin": f"{_TODAY} - n_nationkey * 20",
    "presupuesto": _money("n_nationkey * 1000"),
    "gasto_real": _money("n_nationkey * 730"),
    "impresiones": "n_nationkey * 1000",
    "clics": "n_nationkey * 37",
    "conversiones": "n_nationkey * 3",
    "ingresos_generados": _money("n_nationkey * 2111"),
    "estado": _pick(schemas.ESTADOS_CAMPANA, "n_nationkey % 4 + 1"),
}

CAMPANAS_CLIENTES = {
    "id": "c_custkey",
    "campana_id": "CAST(c_nationkey AS BIGINT)",
    "cliente_id": "c_custkey",
    "fecha_contacto": "CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP{ntz} '2001-06-01 00:00:00' END",
    "convirtio": "c_custkey % 10 = 1",
}

EXPRESSIONS = {
    "clientes": CLIENTES,
    "productos": PRODUCTOS,
    "vendedores": VENDEDORES,
    "ordenes": ORDENES,
    "items_orden": ITEMS,
    "pagos": PAGOS,
    "devoluciones": DEVOLUCIONES,
    "interacciones_clientes": INTERACCIONES,
    "campanas": CAMPANAS,
    "campanas_clientes": CAMPANAS_CLIENTES,
}

# Payments and returns come at most this many days after the order they belong to.
_LAG_DAYS = {"ordenes": 0, "pagos": 89, "devoluciones": 59}


class RetailModel(Mapping[str, DataFrame]):
    """The ten mapped tables, built on first use from the Parquet files below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        split_hot_keys(spark)
        self.spark = spark
        self.path = path
        self._built: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(EXPRESSIONS)

    def __len__(self) -> int:
        return len(EXPRESSIONS)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in EXPRESSIONS:
            raise KeyError(table)
        if table not in self._built:
            self._built[table] = self._build(table, None, None)
        return self._built[table]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.path}/{name}.parquet")

    def scan(self, table: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        """The table with the bounds of a date filter also put on the stored order date.

        A mapped moment lies within a known lag of ``o_orderdate``, so these wider bounds
        drop no wanted row, and unlike the computed column they reach the Parquet reader.
        """
        return self._build(table, since, until)

    def _orders(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        return self.raw("orders").filter(periods.within(F.col("o_orderdate"), since, until))

    def _build(self, table: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        if since is not None:
            since = periods.shift_days(since, -1 - _LAG_DAYS[table])
        columns = EXPRESSIONS[table]
        if table == "clientes":
            base = (
                self.raw("customer")
                .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            )
        elif table == "ordenes":
            base = self._orders(since, until)
        elif table == "items_orden":
            base = self.raw("lineitem")
        elif table == "pagos":
            base = self._build_from(ORDENES, self._orders(since, until), "ordenes").filter(
                PAGOS_FILTER)
        elif table == "devoluciones":
            # One return for each order with a returned line.
            returned = self.raw("lineitem").filter(RETURNED).select("l_orderkey")
            orders = self._build_from(ORDENES, self._orders(since, until), "ordenes")
            base = orders.join(returned, F.col("id") == F.col("l_orderkey"), "left_semi")
        else:
            source = {
                "productos": "part",
                "vendedores": "supplier",
                "interacciones_clientes": "events",
                "campanas": "nation",
                "campanas_clientes": "customer",
            }[table]
            base = self.raw(source)
        return self._build_from(columns, base, table)

    def _build_from(self, columns: dict[str, str], base: DataFrame, table: str) -> DataFrame:
        fill = {"ts": "TIMESTAMP_NTZ", "ntz": "_NTZ", "reps": "_reps",
                "line_id": "monotonically_increasing_id()"}
        if any("{reps}" in text for text in columns.values()):
            base = base.withColumn("_reps", self.raw("supplier").select(F.count("*")).scalar())
        exprs = []
        for field in schemas.schema(table):
            text = columns.get(field.name, "NULL")
            text = text.format(**fill) if "{" in text else text
            exprs.append(f"CAST({text} AS {field.dataType.simpleString()}) AS {field.name}")
        return base.selectExpr(*exprs)
