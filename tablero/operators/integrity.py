"""Integrity and rollup jobs: totals, lifetime value, constraint report, deletions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablero import schemas
from tablero.functions import money, periods
from tablero.operators.conditions import not_cancelled
from tablero.sources.facts import FactStore
from tablero.sources.tables import RestrictedDelete

Tables = Mapping[str, DataFrame]


def with_line_total(items: DataFrame) -> DataFrame:
    """Computed column: quantity x price less the line discount, in exact decimals."""
    charged = (F.lit(100) - F.col("porcentaje_descuento")) * F.lit("0.01").cast("decimal(3,2)")
    total = F.col("cantidad") * F.col("precio_unitario") * charged
    return items.withColumn("total_linea", total.cast("decimal(15,2)"))


def _touched(now: dt.datetime | None) -> Column:
    return F.localtimestamp() if now is None else F.lit(now).cast("timestamp_ntz")


def order_totals(
    orders: DataFrame,
    items: DataFrame,
    changed_ids: DataFrame | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """``monto_total`` = lines + tax + shipping - discount, missing parts as 0.

    With ``changed_ids`` (column ``orden_id``: the orders that gained or lost a line) only
    those orders are recomputed. The planner moves that filter below the line sums when the
    change set is small enough to broadcast.
    """
    lines = items.groupBy(F.col("orden_id").alias("id")).agg(
        money.total(F.col("total_linea")).alias("_lineas")
    )
    due = F.lit(True)
    if changed_ids is None:
        joined = orders.join(lines, "id", "left")
    else:
        changed = changed_ids.select(F.col("orden_id").alias("id")).distinct()
        sums = changed.withColumn("_cambiada", F.lit(True)).join(
            lines.join(changed, "id", "left_semi"), "id", "left"
        )
        joined = orders.join(sums, "id", "left")
        due = F.col("_cambiada").isNotNull()

    values = {
        "monto_total": F.when(due, _due_total("_lineas")).otherwise(F.col("monto_total")),
        "actualizado_en": F.when(due, _touched(now)).otherwise(F.col("actualizado_en")),
    }
    return joined.withColumns(values).select(*orders.columns)


def _due_total(lines: str) -> Column:
    def part(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0).cast("decimal(15,2)"))

    return (
        part(lines) + part("monto_impuesto") + part("costo_envio") - part("monto_descuento")
    ).cast("decimal(15,2)")


def order_totals_in_place(
    store: FactStore,
    months: Sequence[dt.date] | None = None,
    changed_ids: DataFrame | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """``order_totals`` over stored facts, with the column ``mes``: neither side is exchanged.

    Orders and lines are summed and joined in the buckets they are stored in; the few orders of
    very many lines are a branch of their own. With ``months`` only those are read and returned,
    with ``changed_ids`` only those orders change.
    """
    parts = []
    for orders, lines in store.pairs(months):
        sums = lines.groupBy(F.col("orden_id").alias("_orden")).agg(
            money.total(F.col("total_linea")).alias("_lineas"))
        joined = orders.join(sums, F.col("id") == F.col("_orden"), "left")
        due = F.lit(True)
        if changed_ids is not None:
            changed = changed_ids.select(F.col("orden_id").alias("_cambiada")).distinct()
            joined = joined.join(changed, F.col("id") == F.col("_cambiada"), "left")
            due = F.col("_cambiada").isNotNull()
        values = {
            "monto_total": F.when(due, _due_total("_lineas")).otherwise(F.col("monto_total")),
            "actualizado_en": F.when(due, _touched(now)).otherwise(F.col("actualizado_en")),
        }
        parts.append(joined.withColumns(values).select(*orders.columns))
    return reduce(DataFrame.unionByName, parts)


def changed_orders(inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orders touched by a change of lines; a moved line names its old and its new order."""
    return inserted.select("orden_id").union(deleted.select("orden_id")).distinct()


def client_ltv(
    clients: DataFrame,
    orders: DataFrame,
    keep_old: bool = True,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Lifetime value and last purchase over live orders.

    A client without live orders has value 0 and keeps the stored last purchase, or loses it
    with ``keep_old=False``.
    """
    bought = (
        orders.filter(not_cancelled())
        .groupBy(F.col("cliente_id").alias("id"))
        .agg(
            F.sum("monto_total").cast("decimal(15,2)").alias("_valor"),
            F.max("fecha_orden").alias("_ultima"),
        )
    )
    joined = clients.join(bought, "id", "left")
    return joined.withColumns(_valued(keep_old, now)).select(*clients.columns)


def _valued(keep_old: bool, now: dt.datetime | None) -> dict[str, Column]:
    last = F.col("_ultima")
    return {
        "valor_vida_total": F.coalesce(F.col("_valor"), F.lit(0).cast("decimal(15,2)")),
        "fecha_ultima_compra": F.coalesce(last, F.col("fecha_ultima_compra")) if keep_old else last,
        "actualizado_en": _touched(now),
    }


def client_months(orders: DataFrame) -> DataFrame:
    """Live value and last purchase per client and month: (cliente_id, mes, valor, ultima).

    Sums and maxima of months make those of a client, and a month can be computed again when
    one of its orders is cancelled, moved or lowered.
    """
    return orders.filter(not_cancelled()).groupBy(
        "cliente_id", periods.month_of(F.col("fecha_orden")).alias("mes")).agg(
        money.total(F.col("monto_total")).alias("valor"), F.max("fecha_orden").alias("ultima"))


def client_ltv_of_months(
    clients: DataFrame,
    months: DataFrame,
    touched: DataFrame | None = None,
    keep_old: bool = False,
    now: dt.datetime | None = None,
) -> DataFrame:
    """``client_ltv`` from ``client_months`` rows; with ``touched`` (column ``cliente_id``)
    every other client keeps what is stored."""
    due = F.lit(True)
    if touched is not None:
        keys = touched.select("cliente_id").distinct()
        months = months.join(keys, "cliente_id", "left_semi")
        clients_ = clients.join(keys.select(F.col("cliente_id").alias("_tocado")),
                                F.col("id") == F.col("_tocado"), "left")
        due = F.col("_tocado").isNotNull()
    else:
        clients_ = clients
    bought = months.groupBy(F.col("cliente_id").alias("id")).agg(
        F.sum("valor").cast("decimal(15,2)").alias("_valor"), F.max("ultima").alias("_ultima"))
    values = {name: F.when(due, value).otherwise(F.col(name))
              for name, value in _valued(keep_old, now).items()}
    return clients_.join(bought, "id", "left").withColumns(values).select(*clients.columns)


def soft_delete_clients(clients: DataFrame, as_of: dt.date, months: int = 6) -> DataFrame:
    """Deactivate clients acquired before the given number of months."""
    old = F.col("fecha_adquisicion") < F.lit(periods.shift_months(as_of, -months))
    return clients.withColumn("activo", F.when(old, F.lit(False)).otherwise(F.col("activo")))


def constraint_report(t: Tables) -> DataFrame:
    """Violations per rule: (tabla, regla, tipo, violaciones, ejemplo).

    Row rules of a table (required, condition, domain, length, precision) are one aggregation
    over it; the example is the smallest id that breaks the rule. Keys and references of all
    tables are one count per key value: a group holds how often a value is the key and how often
    each reference names it, so it shows repeated keys and orphans at once, and a hot key is
    counted up before it moves. A repeated key counts its rows beyond the first, NULL never
    repeats; an orphan counts each of its rows; the example is the smallest value as text.
    """
    found = reduce(DataFrame.unionByName,
                   [_row_rules(name, t[name]) for name in schemas.TABLES if name in t])
    return found.unionByName(_key_rules(t)).orderBy("tabla", "tipo", "regla")


def _row_rules(name: str, df: DataFrame) -> DataFrame:
    rules: list[tuple[str, str, Column]] = []
    for column in ("id", *schemas.REQUIRED[name]):
        rules.append((column, "no_nulo", F.col(column).isNull()))
    for rule, condition in schemas.CHECKS.get(name, {}).items():
        rules.append((rule, "check", ~F.expr(condition)))
    for column, values in schemas.DOMAINS.get(name, {}).items():
        rules.append((column, "dominio", ~F.col(column).isin(values)))
    for column, most in schemas.LENGTHS.get(name, {}).items():
        rules.append((column, "longitud", F.char_length(column) > most))
    given = dict(df.dtypes)
    for column, kind in schemas.amounts(name).items():
        typed = F.col(column).try_cast(kind)
        broken = F.lit(False) if given[column] == kind else (
            F.col(column).isNotNull() & ~F.col(column).eqNullSafe(typed))
        rules.append((column, "precision", broken))
    counts = df.agg(*[value for i, (_, _, broken) in enumerate(rules) for value in (
        money.count_if(broken).alias(f"n{i}"),
        F.min(F.when(broken, F.col("id"))).cast("string").alias(f"e{i}"))])
    rows = F.array(*[
        F.struct(F.lit(name).alias("tabla"), F.lit(rule).alias("regla"), F.lit(kind).alias("tipo"),
                 F.col(f"n{i}").alias("violaciones"), F.col(f"e{i}").alias("ejemplo"))
        for i, (rule, kind, _) in enumerate(rules)
    ])
    return counts.select(F.inline(rows))


def _key_rules(t: Tables) -> DataFrame:
    """Repeated keys and orphans: a value's group is its key, its slot 0 the key's own rows and
    the others the references to it."""
    groups: list[tuple[str, tuple[str, ...]]] = [
        (name, key) for name in schemas.TABLES if name in t for key in schemas.UNIQUE[name]]
    slots: dict[schemas.Reference, tuple[int, int]] = {}
    for ref in schemas.REFERENCES:
        if ref.child in t and ref.parent in t:
            group = groups.index((ref.parent, ("id",)))
            slots[ref] = group, 1 + sum(g == group for g, _ in slots.values())
    parts = []
    for name in t:
        values = [(groups.index((name, key)), 0, F.concat_ws(",", *key), key)
                  for key in schemas.UNIQUE[name]]
        values += [(*place, F.col(ref.column).cast("string"), (ref.column,))
                   for ref, place in slots.items() if ref.child == name]
        parts.append(t[name].select(F.inline(F.array(*[
            F.struct(F.lit(group).alias("grupo"), F.lit(slot).alias("lugar"), F.when(
                reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), value)
                .alias("valor"))
            for group, slot, value, columns in values]))).filter("valor is not null"))
    most = max((slot for _, slot in slots.values()), default=0)
    counted = reduce(DataFrame.unionByName, parts).groupBy("grupo", "valor").agg(
        *[money.count_if(F.col("lugar") == k).alias(f"n{k}") for k in range(most + 1)])
    repeated, orphan = F.col("n0") > 1, F.col("n0") == 0
    found = counted.groupBy("grupo").agg(
        F.sum(F.when(repeated, F.col("n0") - 1)).alias("v0"),
        F.min(F.when(repeated, F.col("valor"))).alias("e0"),
        *[value for k in range(1, most + 1) for value in (
            F.sum(F.when(orphan, F.col(f"n{k}"))).alias(f"v{k}"),
            F.min(F.when(orphan & (F.col(f"n{k}") > 0), F.col("valor"))).alias(f"e{k}"))])
    rules = [(g, 0, name, ",".join(key), "unico") for g, (name, key) in enumerate(groups)]
    rules += [(g, slot, ref.child, f"{ref.column} -> {ref.parent}", "referencia")
              for ref, (g, slot) in slots.items()]
    known = t[next(iter(t))].sparkSession.createDataFrame(
        rules, "grupo int, lugar int, tabla string, regla string, tipo string")
    pick = [F.when(F.col("lugar") == k, F.struct(F.col(f"v{k}").alias("v"), F.col(f"e{k}").alias("e")))
            for k in range(most + 1)]
    return known.join(found, "grupo", "left").withColumn("_", F.coalesce(*pick)).select(
        "tabla", "regla", "tipo", F.coalesce(F.col("_.v"), F.lit(0)).alias("violaciones"),
        F.col("_.e").alias("ejemplo"))


def delete_keys(t: Tables, table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting ``keys`` (column ``id``) from ``table``.

    Rows that refer to a deleted key are deleted too, lose the link, or forbid the
    deletion, as the schema declares for that column. Only the tables that change are returned.
    """
    keys = keys.select("id").distinct()
    for ref in _references(table, t):
        if ref.on_delete == "restrict":
            held = t[ref.child].join(keys, F.col(ref.column) == keys["id"], "left_semi")
            if not held.isEmpty():
                raise RestrictedDelete(f"{ref.child}.{ref.column} still refers to {table}")
    left = {**t}
    left[table] = t[table].join(keys, "id", "left_anti")
    changed = {table}
    for ref in _references(table, t):
        child = left[ref.child]
        gone = keys.select(F.col("id").alias("_borrado"))
        hit = F.col(ref.column) == F.col("_borrado")
        if ref.on_delete == "set null":
            value = F.when(F.col("_borrado").isNull(), F.col(ref.column))
            left[ref.child] = (
                child.join(gone, hit, "left").withColumn(ref.column, value).select(*child.columns)
            )
            changed.add(ref.child)
        elif ref.on_delete == "cascade":
            doomed = child.join(gone, hit, "left_semi").select("id")
            after = delete_keys(left, ref.child, doomed)
            left.update(after)
            changed.update(after)
    return {name: left[name] for name in changed}


def _references(parent: str, t: Tables) -> list[schemas.Reference]:
    return [r for r in schemas.REFERENCES if r.parent == parent and r.child in t]
