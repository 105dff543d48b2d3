"""Synthetic sales data as table jobs: every row is a function of its id and the seed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablero import schemas
from tablero.functions import draws
from tablero.functions.draws import above, amount, choice, scaled, u
from tablero.functions.ranking import dense_index
from tablero.operators.integrity import with_line_total
from tablero.sources.tables import conform

Tables = Mapping[str, DataFrame]

# Names the generators draw from.
NOMBRES_M = ["Carlos", "Miguel", "Juan", "Luis", "Pedro", "Roberto", "Antonio", "Diego",
             "Francisco", "Alejandro", "Javier", "Andrés", "Sergio", "Ricardo", "Fernando"]
NOMBRES_F = ["María", "Carmen", "Rosa", "Isabel", "Josefina", "Ana", "Francisca", "Dolores",
             "Catalina", "Antonia", "Montserrat", "Pilar", "Sofía", "Teresa", "Laura"]
APELLIDOS = ["García", "Martínez", "Rodríguez", "López", "Hernández", "González", "Pérez",
             "Sánchez", "Ramírez", "Torres", "Flores", "Rivera", "Gómez", "Díaz", "Reyes"]

# The shorter lists names are looked up in by index.
INDICE_M = ["Carlos", "Miguel", "Juan", "Luis", "Pedro", "Jorge", "Andrés", "Fernando", "Diego",
            "Sergio"]
INDICE_F = ["María", "Ana", "Lucía", "Sofía", "Valentina", "Camila", "Daniela", "Paula", "Carla",
            "Laura"]
INDICE_APELLIDOS = ["García", "Martínez", "Rodríguez", "López", "Pérez", "Gómez", "Fernández",
                    "Díaz", "Sánchez", "Romero"]

# Attributes of clients, products and reps.
DOMINIOS = ["gmail.com", "yahoo.com", "outlook.com", "empresa.com", "mail.com"]
AREAS = ["11", "351", "261"]
INDUSTRIAS = ["Tecnología", "Finanzas", "Salud", "Comercio", "Manufactura", "Educación",
              "Consultoría", "Energía"]
PAISES = ["Argentina", "Chile", "Uruguay", "Colombia", "México"]
PROVINCIAS = ["Buenos Aires", "Córdoba", "Santa Fe", "Mendoza", "Tucumán", "Rosario"]
CIUDADES = ["Buenos Aires", "Córdoba", "Rosario", "Mendoza", "Tucumán", "Mar del Plata", "Salta",
            "Santa Fe", "San Juan", "Resistencia"]
CATEGORIAS = ["Electrónica", "Software", "Servicios", "Hardware", "Consultoría"]
SUBCATEGORIAS = {
    "Electrónica": ["Laptops", "Tablets", "Accesorios", "Monitores", "Almacenamiento"],
    "Software": ["Base de Datos", "CRM", "ERP", "Analítica", "Seguridad"],
    "Servicios": ["Soporte", "Capacitación", "Implementación", "Mantenimiento", "Consultoría"],
}
MARCAS = ["TechCorp", "InnovaTech", "SoftPro", "CloudSys", "DataFlow", "SecureIT"]
EQUIPOS = ["Empresas", "PyMEs", "Startups", "Estratégico"]
TERRITORIOS = ["Norte", "Sur", "Este", "Oeste", "Centro"]

# Chance of each order state among the orders the states before it left over.
STATE_ODDS = [("cancelado", 0.05), ("pendiente", 0.10), ("confirmado", 0.15),
              ("procesando", 0.20), ("enviado", 0.30)]

MAX_LINES = 8


def full_name(gender: Column, first: Column, last: Column) -> Column:
    """First name by gender and surname, from three draws."""
    given = F.when(above(gender, 0.5), choice(first, NOMBRES_M)).otherwise(choice(first, NOMBRES_F))
    return F.concat_ws(" ", given, choice(last, APELLIDOS))


def _capped(draw: Column, last: int, values: list[str]) -> Column:
    """Rounded draw over 0 … last where the surplus places fall to the last value."""
    return draws.pick(values, F.least(scaled(draw, last), F.lit(len(values) - 1)))


def email(name: Column, row_id: Column, domain: Column) -> Column:
    """Lower-case address; the id in the local part keeps it unique."""
    local = F.concat_ws(".", F.translate(name, " óé", ".oe"), row_id.cast("string"))
    return F.lower(F.concat_ws("@", local, _capped(domain, len(DOMINIOS), DOMINIOS)))


def phone(area: Column, number: Column) -> Column:
    return F.concat_ws(
        " ", F.lit("+54"), _capped(area, 3, AREAS), draws.padded(scaled(number, 99_999_999), 8)
    )


def _days_before(as_of: dt.date, days: Column) -> Column:
    return F.date_sub(F.lit(as_of), days.cast("int"))


def _moment(day: Column) -> Column:
    return day.cast("timestamp_ntz")


# Rows one task generates: few enough to spread a small load over the cores, and for large
# loads enough that a task writes a file worth reading.
_SMALL_TASK = 20_000
_LARGE_TASK = 4_000_000


def ids(spark: SparkSession, n: int, first_id: int = 1) -> DataFrame:
    """``n`` consecutive ids, cut into tasks by their number."""
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(n // _SMALL_TASK, cores), n // _LARGE_TASK)
    return spark.range(first_id, first_id + n, 1, tasks)


def names_by_index(df: DataFrame, genero: str, i: str, j: str) -> DataFrame:
    """Names by gender and list places; a place outside the lists gives no row.

    The lists are constants of twenty and ten rows, so both are broadcast.
    """
    one = df.sparkSession.range(1)

    def listed(words: list[str], place: str, value: str) -> DataFrame:
        numbered = one.select(F.posexplode(F.split(F.lit(",".join(words)), ",")).alias("_n", value))
        return numbered.select((F.col("_n") + F.lit(1)).alias(place), value)

    given = listed(INDICE_M, "_i", "nombre").withColumn("_g", F.lit("M")).unionByName(
        listed(INDICE_F, "_i", "nombre").withColumn("_g", F.lit("F"))
    )
    last = listed(INDICE_APELLIDOS, "_j", "apellido")
    return (
        df.join(F.broadcast(given), (F.col(genero) == F.col("_g")) & (F.col(i) == F.col("_i")))
        .join(F.broadcast(last), F.col(j) == F.col("_j"))
        .withColumn("nombre_completo", F.concat_ws(" ", "nombre", "apellido"))
        .drop("_g", "_i", "_j")
    )


def client_rows(keys: DataFrame, as_of: dt.date, seed: int = 0) -> DataFrame:
    """One client per ``id``."""
    name = full_name(u(0), u(1), u(2))
    segment = choice(u(6), schemas.SEGMENTOS)
    rows = draws.with_draws(keys, "clientes", seed, 15, "id").withColumns(
        {"nombre": name, "segmento": segment}
    )
    rows = rows.select(
        "id",
        draws.row_uuid("clientes", seed, "id").alias("uuid"),
        "nombre",
        email(F.col("nombre"), F.col("id"), u(3)).alias("email"),
        phone(u(4), u(5)).alias("telefono"),
        "segmento",
        choice(u(7), INDUSTRIAS).alias("industria"),
        choice(u(8), schemas.TAMANOS_EMPRESA).alias("tamano_empresa"),
        choice(u(9), PAISES).alias("pais"),
        choice(u(10), PROVINCIAS).alias("provincia"),
        choice(u(11), CIUDADES).alias("ciudad"),
        draws.padded(scaled(u(12), 9999), 4).alias("codigo_postal"),
        amount(u(13), 1_000_000, 99_000_000, 2, "decimal(15,2)").alias("limite_credito"),
        F.lit(0).alias("valor_vida_total"),
        _moment(_days_before(as_of, scaled(u(14), 365))).alias("fecha_adquisicion"),
        (F.col("segmento") != F.lit("inactivo")).alias("activo"),
        _moment(F.lit(as_of)).alias("creado_en"),
        _moment(F.lit(as_of)).alias("actualizado_en"),
    )
    return conform(rows, "clientes")


def generate_clients(
    spark: SparkSession,
    n: int = 500,
    as_of: dt.date | None = None,
    seed: int = 0,
    first_id: int = 1,
) -> DataFrame:
    return client_rows(ids(spark, n, first_id), as_of or dt.date.today(), seed)


def product_rows(keys: DataFrame, as_of: dt.date, seed: int = 0) -> DataFrame:
    """One product per ``id``; the subcategory follows the category."""
    category = F.col("categoria")
    sub = F.lit("Otro")
    for value, subs in SUBCATEGORIAS.items():
        sub = F.when(category == F.lit(value), choice(u(1), subs)).otherwise(sub)
    rows = (
        draws.with_draws(keys, "productos", seed, 13, "id")
        .withColumns({"categoria": choice(u(0), CATEGORIAS), "marca": choice(u(2), MARCAS)})
        .withColumn("subcategoria", sub)
    )
    number = (F.col("id") - F.lit(1)).cast("string")
    rows = rows.select(
        "id",
        draws.row_uuid("productos", seed, "id").alias("uuid"),
        F.concat_ws(" ", "marca", "subcategoria", number).alias("nombre"),
        F.concat(F.lit("SKU-"), draws.padded(number, 6)).alias("sku"),
        F.concat(
            F.lit("Producto de alta calidad: "), "subcategoria", F.lit(" de "), "marca"
        ).alias("descripcion"),
        "categoria",
        "subcategoria",
        "marca",
        amount(u(3), 10_000, 990_000, 2, "decimal(10,2)").alias("precio_lista"),
        amount(u(4), 5_000, 495_000, 2, "decimal(10,2)").alias("precio_costo"),
        scaled(u(5), 1000).alias("stock_actual"),
        F.when(above(u(6), 0.7), scaled(u(7), 50) + F.lit(10)).otherwise(F.lit(10))
        .alias("stock_minimo"),
        amount(u(8), 10, 9_990, 2, "decimal(8,2)").alias("peso_kg"),
        amount(u(9), 1, 9_999, 3, "decimal(8,3)").alias("volumen_m3"),
        above(u(10), 0.7).alias("es_digital"),
        _days_before(as_of, scaled(u(11), 730)).alias("fecha_lanzamiento"),
        above(u(12), 0.15).alias("activo"),
        _moment(F.lit(as_of)).alias("creado_en"),
        _moment(F.lit(as_of)).alias("actualizado_en"),
    )
    return conform(rows, "productos")


def generate_products(
    spark: SparkSession,
    n: int = 200,
    as_of: dt.date | None = None,
    seed: int = 0,
    first_id: int = 1,
) -> DataFrame:
    return product_rows(ids(spark, n, first_id), as_of or dt.date.today(), seed)


def rep_rows(keys: DataFrame, as_of: dt.date, seed: int = 0) -> DataFrame:
    """One sales rep per ``id``; about 30 % report to a rep with a lower id."""
    row_id = F.col("id")
    boss = draws.position(u(9), u(10), row_id - F.lit(1)) + F.lit(1)
    rows = draws.with_draws(keys, "vendedores", seed, 15, "id").withColumn(
        "nombre", full_name(u(0), u(1), u(2))
    )
    rows = rows.select(
        "id",
        draws.row_uuid("vendedores", seed, "id").alias("uuid"),
        "nombre",
        email(F.col("nombre"), row_id, u(3)).alias("email"),
        phone(u(4), u(5)).alias("telefono"),
        choice(u(6), EQUIPOS).alias("equipo"),
        choice(u(7), TERRITORIOS).alias("territorio"),
        F.when((row_id > 1) & above(u(8), 0.7), boss).alias("gerente_id"),
        amount(u(11), 500, 1_000, 2, "decimal(5,2)").alias("tasa_comision"),
        amount(u(12), 5_000_000, 20_000_000, 2, "decimal(15,2)").alias("cuota_mensual"),
        above(u(13), 0.1).alias("activo"),
        _days_before(as_of, scaled(u(14), 1095)).alias("fecha_contratacion"),
        _moment(F.lit(as_of)).alias("creado_en"),
        _moment(F.lit(as_of)).alias("actualizado_en"),
    )
    return conform(rows, "vendedores")


def generate_reps(
    spark: SparkSession,
    n: int = 50,
    as_of: dt.date | None = None,
    seed: int = 0,
    first_id: int = 1,
) -> DataFrame:
    return rep_rows(ids(spark, n, first_id), as_of or dt.date.today(), seed)


def order_state(draw: Column) -> Column:
    """State from one draw; the odds apply in turn to what the states before left over."""
    state, left, bound = None, 1.0, 0.0
    for value, share in STATE_ODDS:
        bound += left * share
        left *= 1 - share
        hit = ~above(draw, round(bound, 10))
        state = F.when(hit, F.lit(value)) if state is None else state.when(hit, F.lit(value))
    return state.otherwise(F.lit("entregado"))


def order_rows(
    keys: DataFrame, as_of: dt.date, dias_atras: int = 365, seed: int = 0
) -> DataFrame:
    """Orders without client and rep: everything a row can tell from its own id."""
    state = F.col("estado")
    paid = (
        F.when(state == F.lit("entregado"), choice(u(2), schemas.ESTADOS_PAGO_ORDEN))
        .when(state == F.lit("cancelado"), F.lit("reembolsado"))
        .otherwise(F.lit("pendiente"))
    )
    day = _days_before(as_of, scaled(u(1), dias_atras))
    discount = F.when(above(u(6), 0.7), amount(u(7), 500, 2_000, 2, "decimal(5,2)")).otherwise(
        F.lit(0).cast("decimal(5,2)")
    )
    return (
        draws.with_draws(keys, "ordenes", seed, 13, "id")
        .withColumn("estado", order_state(u(0)))
        .select(
            "id",
            draws.row_uuid("ordenes", seed, "id").alias("uuid"),
            _moment(day).alias("fecha_orden"),
            F.date_add(day, 5).alias("fecha_entrega_prometida"),
            "estado",
            paid.alias("estado_pago"),
            choice(u(3), schemas.METODOS_PAGO).alias("metodo_pago"),
            amount(u(4), 5_000, 45_000, 2, "decimal(15,2)").alias("monto_impuesto"),
            amount(u(5), 1_000, 9_000, 2, "decimal(15,2)").alias("costo_envio"),
            discount.alias("porcentaje_descuento"),
            *[F.lit(0).alias(c) for c in ("subtotal", "monto_descuento", "monto_total")],
            F.lit("sistema").alias("creado_por"),
            _moment(F.lit(as_of)).alias("creado_en"),
            _moment(F.lit(as_of)).alias("actualizado_en"),
            above(u(8), 0.2).alias("_con_vendedor"),
            *[u(i) for i in range(9, 13)],
        )
    )


def _numbered_active(df: DataFrame, *columns: str) -> DataFrame:
    return dense_index(df.filter(F.col("activo")).select("id", *columns), "id", "_lugar")


def _active_count(df: DataFrame) -> Column:
    return df.filter(F.col("activo")).select(F.count(F.lit(1))).scalar()


def assign_parties(rows: DataFrame, t: Tables) -> DataFrame:
    """Give each order a random active client and, for 80 %, a random active rep.

    The draw is a place in the numbered list of active keys, so this is an equi-join on
    evenly spread keys however many clients there are.
    """
    client = _numbered_active(t["clientes"]).select(
        F.col("_lugar").alias("_lc"), F.col("id").alias("cliente_id")
    )
    rep = _numbered_active(t["vendedores"]).select(
        F.col("_lugar").alias("_lv"), F.col("id").alias("vendedor_id")
    )
    placed = rows.withColumns(
        {
            "_pc": draws.position(u(9), u(10), _active_count(t["clientes"])),
            "_pv": F.when(
                F.col("_con_vendedor"),
                draws.position(u(11), u(12), _active_count(t["vendedores"])),
            ),
        }
    )
    joined = placed.join(client, F.col("_pc") == F.col("_lc")).join(
        rep, F.col("_pv") == F.col("_lv"), "left"
    )
    return conform(joined, "ordenes")


def generate_orders(
    t: Tables,
    spark: SparkSession,
    n: int = 5000,
    dias_atras: int = 365,
    as_of: dt.date | None = None,
    seed: int = 0,
    first_id: int = 1,
) -> DataFrame:
    rows = order_rows(ids(spark, n, first_id), as_of or dt.date.today(), dias_atras, seed)
    return assign_parties(rows, t)


def generate_items(orders: DataFrame, products: DataFrame, seed: int = 0) -> DataFrame:
    """One to eight lines per order on random active products at list price.

    ``orders`` needs ``id`` and ``estado`` only.
    """
    lines = scaled(u(0), MAX_LINES - 1) + F.lit(1)
    opened = (
        draws.with_draws(orders.select("id", "estado"), "lineas", seed, 1, "id")
        .select(
            F.col("id").alias("orden_id"),
            "estado",
            F.explode(F.sequence(F.lit(1), lines.cast("int"))).alias("linea"),
        )
        .withColumn("id", (F.col("orden_id") - F.lit(1)) * F.lit(MAX_LINES) + F.col("linea"))
    )
    product = _numbered_active(products, "precio_lista").select(
        F.col("_lugar").alias("_lp"), F.col("id").alias("producto_id"), "precio_lista"
    )
    quantity = scaled(u(2), 10) + F.lit(1)
    state = F.col("estado")
    returned = F.when(
        (state == F.lit("devuelto")) & above(u(5), 0.5), scaled(u(6), F.col("cantidad"))
    ).otherwise(F.lit(0))
    rows = (
        draws.with_draws(opened, "items", seed, 7, "id")
        .withColumn("_pp", draws.position(u(0), u(1), _active_count(products)))
        .join(product, F.col("_pp") == F.col("_lp"))
        .withColumn("cantidad", quantity.cast("int"))
        .select(
            "id",
            "orden_id",
            "producto_id",
            "cantidad",
            F.col("precio_lista").alias("precio_unitario"),
            F.when(above(u(3), 0.7), amount(u(4), 0, 2_000, 2, "decimal(5,2)"))
            .otherwise(F.lit(0).cast("decimal(5,2)"))
            .alias("porcentaje_descuento"),
            state.isin("entregado", "enviado").alias("completado"),
            returned.alias("cantidad_devuelta"),
        )
    )
    return conform(with_line_total(rows), "items_orden")


def generate_payments(
    orders: DataFrame, as_of: dt.date, seed: int = 0, first_id: int = 1
) -> DataFrame:
    """One payment per order that is paid, partly paid or overdue and has a total.

    About 70 % pay in full, the others 30 to 100 % of the total. Payment ids follow the order
    ids, shifted to begin at ``first_id``.
    """
    due = F.col("estado_pago").isin("pagado", "parcial", "vencido") & (F.col("monto_total") > 0)
    total = F.col("monto_total")
    share = amount(u(1), 300_000, 700_000, 6, "decimal(7,6)")
    part = (total * share).cast("decimal(15,2)")
    day = _days_before(as_of, scaled(u(3), 365))
    charged = orders.filter(due).select(
        (F.col("id") + F.lit(first_id - 1)).alias("id"),
        F.col("id").alias("orden_id"),
        "monto_total",
    )
    rows = draws.with_draws(charged, "pagos", seed, 5, "id").select(
        "id",
        draws.row_uuid("pagos", seed, "id").alias("uuid"),
        "orden_id",
        F.when(above(u(0), 0.3), total).otherwise(part).alias("monto"),
        _moment(day).alias("fecha_pago"),
        choice(u(2), schemas.METODOS_PAGO).alias("metodo_pago"),
        F.concat(F.lit("REF-"), draws.padded(scaled(u(4), 999_999), 8)).alias("numero_referencia"),
        F.lit("completado").alias("estado"),
        _moment(F.lit(as_of)).alias("creado_en"),
    )
    return conform(rows, "pagos")
