"""Pieces of checking SQL: mapped tables as WITH text, and exact arithmetic."""

from __future__ import annotations

from tablero.sources import retail

AS_OF = f"DATE '{retail.AS_OF}'"

_FROM = {
    "clientes": "customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey",
    "productos": "part",
    "vendedores": "supplier",
    "ordenes": "orders",
    "items_orden": "lineitem",
    "pagos": f"ordenes WHERE {retail.PAGOS_FILTER}",
    "devoluciones": "ordenes WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "interacciones_clientes": "events",
    "campanas": "nation",
    "campanas_clientes": "customer",
}
_NEEDS = {"pagos": ("ordenes",), "devoluciones": ("ordenes",)}


def tables(*names: str) -> str:
    """``WITH`` text that defines the named tables and those they are mapped from."""
    wanted: list[str] = []
    for name in names:
        for table in (*_NEEDS.get(name, ()), name):
            if table not in wanted:
                wanted.append(table)
    parts = []
    for table in wanted:
        fill = {"ts": "TIMESTAMP", "ntz": "", "reps": "(SELECT count(*) FROM supplier)",
                "line_id": "row_number() OVER ()"}
        columns = ",\n    ".join(
            f"{text.format(**fill) if '{' in text else text} AS {name}"
            for name, text in retail.EXPRESSIONS[table].items()
        )
        parts.append(f"{table} AS (\n  SELECT {columns}\n  FROM {_FROM[table]}\n)")
    return "WITH " + ",\n".join(parts)


def money(value: str) -> str:
    return f"CAST({value} AS DECIMAL(25,2))"


def cents(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(25,2)) * 100 AS HUGEINT)"


def fraction(num: str, den: str, digits: int = 2, kind: str = "DECIMAL(15,2)") -> str:
    """num / den for integers, rounded half away from zero; NULL for a zero divisor."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    rounded = f"((2 * abs({n}) * {10 ** digits} + abs({d})) // (2 * abs({d})))"
    unit = f"CAST('{10 ** -digits:.{digits}f}' AS DECIMAL({digits + 1},{digits}))"
    signed = f"CAST(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END * {rounded}" \
             " AS DECIMAL(25,0))"
    return f"CASE WHEN {d} <> 0 THEN CAST({signed} * {unit} AS {kind}) END"


def pct(num: str, den: str) -> str:
    return fraction(f"100 * ({num})", den)


def average(amount: str, digits: int = 2) -> str:
    """Mean of a money column."""
    return quotient(f"sum({amount})", f"count({amount})", digits)


def quotient(amount: str, n: str, digits: int = 2) -> str:
    """A money value divided by a count."""
    kind = "DECIMAL(15,2)" if digits == 2 else "DECIMAL(19,6)"
    return fraction(cents(amount), f"100 * ({n})", digits, kind)


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def sum_if(amount: str, condition: str) -> str:
    """Sum over the rows of the group that meet the condition: 0 if none, NULL if no row."""
    chosen = money(f"coalesce(sum({amount}) FILTER (WHERE {condition}), 0)")
    return f"CASE WHEN count(*) > 0 THEN {chosen} END"


def month(value: str) -> str:
    return f"CAST(date_trunc('month', {value}) AS DATE)"


def day(value: str) -> str:
    return f"CAST({value} AS DATE)"


def age(value: str) -> str:
    """Whole days from a moment to the reference date, as INTEGER."""
    return f"CAST({AS_OF} - CAST({value} AS DATE) AS INTEGER)"


IN_MONTH = f"date_trunc('month', fecha_orden) = date_trunc('month', {AS_OF})"
LIVE = "estado <> 'cancelado'"
OPEN_PAYMENT = "estado_pago IN ('pendiente', 'parcial', 'vencido')"
UNPAID = "estado_pago IN ('pendiente', 'vencido')"


def since(column: str, interval: str) -> str:
    return f"{column} >= {AS_OF} - INTERVAL '{interval}'"
