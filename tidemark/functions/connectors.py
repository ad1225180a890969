"""Fuzzy connectives, activation and accumulation as expression builders, and NaN-skipping arithmetic."""

from __future__ import annotations

from tidemark.functions.sqltext import case, name, num

PLAIN_AND = {
    "min": lambda a, b: f"least({a}, {b})",
    "product": lambda a, b: f"({a} * {b})",
    "bounded_difference": lambda a, b: f"greatest(0D, {a} + {b} - 1D)",
    "drastic": lambda a, b: case([(f"{a} = 1", b), (f"{b} = 1", a)], "0D"),
    "nilpotent": lambda a, b: case([(f"{a} + {b} > 1", f"least({a}, {b})")], "0D"),
    "hamacher": lambda a, b: case([(f"{a} = 0 AND {b} = 0", "0D")], f"({a} * {b}) / ({a} + {b} - {a} * {b})"),
}

PLAIN_OR = {
    "max": lambda a, b: f"greatest({a}, {b})",
    "probabilistic": lambda a, b: f"({a} + {b} - {a} * {b})",
    "bounded_sum": lambda a, b: f"least(1D, {a} + {b})",
    "drastic": lambda a, b: case([(f"{a} = 0", b), (f"{b} = 0", a)], "1D"),
    "nilpotent": lambda a, b: case([(f"{a} + {b} < 1", f"greatest({a}, {b})")], "1D"),
    "einstein": lambda a, b: f"(({a} + {b}) / (1D + {a} * {b}))",
}

def _null_if_any(join):
    """``least`` and ``greatest`` skip nulls, and a case reads a null comparison as false: a missing degree must stay missing."""
    return lambda a, b: f"if(isnull({a} + {b}), NULL, {join(a, b)})"


AND = {k: _null_if_any(f) for k, f in PLAIN_AND.items()}
OR = {k: _null_if_any(f) for k, f in PLAIN_OR.items()}

# Choosing one connective fixes its dual.
DUAL = {
    "min": "max",
    "product": "probabilistic",
    "bounded_difference": "bounded_sum",
    "drastic": "drastic",
    "nilpotent": "nilpotent",
    "hamacher": "einstein",
}

ACTIVATION = {
    "min": lambda strength, degree: f"least({strength}, {degree})",
    "product": lambda strength, degree: f"({strength} * {degree})",
}

ACCUMULATION = {
    "max": lambda acc, y: f"greatest({acc}, {y})",
    "bounded_sum": lambda acc, y: f"least(1D, {acc} + {y})",
    "normed_sum": lambda acc, y: f"(({acc} + {y}) / greatest(1D, {acc} + {y}))",
    "probabilistic": lambda acc, y: f"({acc} + {y} - {acc} * {y})",
    "sum": lambda acc, y: f"({acc} + {y})",
}

NAN = num(float("nan"))
PLUS_INF, MINUS_INF = num(float("inf")), num(float("-inf"))


def _divide(a: str, b: str) -> str:
    """Division with IEEE results for a zero divisor (ANSI mode would raise)."""
    at_zero = case([(f"{a} > 0 AND NOT isnan({a})", PLUS_INF), (f"{a} < 0", MINUS_INF)], NAN)
    return case([(f"{b} = 0", at_zero)], f"{a} / {b}")


def _log(fn: str):
    return lambda x: case([(f"isnan({x}) OR {x} < 0", NAN), (f"{x} = 0", MINUS_INF)], f"{fn}({x})")


UNARY = {
    "exp": lambda x: f"exp({x})",
    "ln": _log("ln"),
    "log10": _log("log10"),
    "sin": lambda x: f"sin({x})",
    "cos": lambda x: f"cos({x})",
    "tan": lambda x: f"tan({x})",
    "abs": lambda x: f"abs({x})",
}


def arithmetic(tree) -> str:
    """Expression text of an arithmetic tree: a number, a column name, or (operator, operand, ...).

    ``+ - * /`` take any number of operands and skip those that are NaN (or null); one-operand ``-``
    negates; ``first`` is the first operand that is not NaN.
    """
    if isinstance(tree, str):
        return f"coalesce(double({name(tree)}), {NAN})"
    if isinstance(tree, (int, float)):
        return num(tree)
    operator, *operands = tree
    terms = [arithmetic(t) for t in operands]
    if operator in UNARY:
        return UNARY[operator](terms[0])
    if operator == "^":
        return f"pow({terms[0]}, {terms[1]})"
    if operator == "%":
        return case([(f"{terms[1]} = 0", NAN)], f"{terms[0]} % {terms[1]}")
    if operator == "-" and len(terms) == 1:
        return f"(-{terms[0]})"
    joins = {
        "+": lambda a, b: f"{a} + {b}",
        "-": lambda a, b: f"{a} - {b}",
        "*": lambda a, b: f"{a} * {b}",
        "/": _divide,
        "first": lambda a, b: a,
    }
    out = terms[0]
    for term in terms[1:]:
        out = case([(f"isnan({term})", out), (f"isnan({out})", term)], joins[operator](out, term))
    return f"({out})"
