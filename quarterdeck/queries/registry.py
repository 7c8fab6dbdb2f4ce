"""Where queries and their SQL counterparts are entered by name."""

from quarterdeck.functions.text import WHITE_SPACE
from quarterdeck.queries import views

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under the name of its function, with its SQL counterpart if there is one."""

    def enter(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = views.with_views(sql)
        return build

    return enter


def text(value: str) -> str:
    """A value as an SQL literal inside a counterpart."""
    return "'" + value.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {text(WHITE_SPACE)})"


def tenth(expr: str) -> str:
    """Rounding to one decimal by the exact binary value, ties to even."""
    high = f"(({expr}) * 134217729::double - (({expr}) * 134217729::double - ({expr})))"
    floor = f"floor(({expr}) * 10::double)"
    side = f"(({high} * 20::double - ({floor} * 2 + 1)) + (({expr}) - {high}) * 20::double)"
    return (
        f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE ({floor} + CASE WHEN {side} > 0 OR ({side} = 0 AND "
        f"{floor}::bigint % 2 <> 0) THEN 1 ELSE 0 END) / 10::double END"
    )
