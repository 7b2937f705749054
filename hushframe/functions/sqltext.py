"""Column expressions as SQL text, so that SQL functions have the very bodies that the DataFrame functions have."""

from __future__ import annotations

from pyspark.sql import Column

INFIX = {"+", "-", "*", "/", "%", "=", "<=>", "<", "<=", ">", ">=", "and", "or"}


def as_sql(column: Column) -> str:
    return _render(column._jc.node())


def _each(items) -> list[str]:
    return [_render(items.apply(i)) for i in range(items.size())]


def _render(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name, given = node.functionName(), _each(node.arguments())
        if name in INFIX and len(given) == 2:
            return f"({given[0]} {name} {given[1]})"
        if name in ("!", "not"):
            return f"(NOT {given[0]})"
        if name == "in":
            return f"({given[0]} IN ({', '.join(given[1:])}))"
        return f"{name}({', '.join(given)})"
    if kind == "LambdaFunction":
        names = _each(node.arguments())
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_render(node.function())}"
    if kind == "CaseWhenOtherwise":
        branches = node.branches()
        pairs = [(branches.apply(i)._1(), branches.apply(i)._2()) for i in range(branches.size())]
        last = node.otherwise()
        rest = f" ELSE {_render(last.get())}" if last.isDefined() else ""
        return "CASE" + "".join(f" WHEN {_render(a)} THEN {_render(b)}" for a, b in pairs) + rest + " END"
    if kind == "Cast":
        return f"CAST({_render(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return f"{_render(node.child())} AS `{node.name().apply(0)}`"
    if kind == "UnresolvedExtractValue":
        return f"{_render(node.child())}[{_render(node.extraction())}]"
    if kind in ("Literal", "UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        return node.sql()
    raise ValueError(f"no SQL text for {kind}: {node.sql()[:200]}")
