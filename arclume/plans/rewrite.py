"""The one rewrite that the optimizer lacks: a reduction moves inside of a monotonic function, so that the function runs once."""

from __future__ import annotations

from arclume.functions import cel

#: Monotonic wherever they are defined, and defined everywhere.
RISING = {"exp", "exp2", "exp10", "expm1", "cbrt", "atan", "sinh", "tanh", "asinh", "sigmoid", "relu", "floor", "ceil"}
#: Monotonic where they are defined; outside they give null or NaN, so the rewrite needs the promise that no value lies there.
RISING_ON_POSITIVE = {"log", "log2", "log10", "log1p", "sqrt"}


def hoist(kind: str, node: cel.Node, positive: bool = False) -> tuple[list[str], str, cel.Node]:
    """``kind`` (max or min) of ``node`` as (functions to apply outside, outermost first; the reduction inside; its expression).

    max(exp(x)) becomes exp(max(x)), max(-x) becomes -(min(x)). ``positive`` promises that arguments of logarithms and roots are above 0.
    """
    outside: list[str] = []
    while kind in ("max", "min"):
        if isinstance(node, cel.Unary) and node.op == "-":
            outside.append("-")
            kind, node = "min" if kind == "max" else "max", node.of
        elif isinstance(node, cel.Call) and len(node.args) == 1 and (node.name in RISING or positive and node.name in RISING_ON_POSITIVE):
            outside.append(node.name)
            node = node.args[0]
        else:
            break
    return outside, kind, node


def shown(kind: str, node: cel.Node, positive: bool = False) -> str:
    """The rewritten reduction as text."""
    outside, kind, inner = hoist(kind, node, positive)
    text = f"({kind} {cel.show(inner)})"
    for name in reversed(outside):
        text = f"({name} {text})"
    return text
