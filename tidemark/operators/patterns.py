"""Patterns as rows: ``pattern_id``, ``class`` and ``masks`` (one BIGINT per layout word).

Functions named after a property give it as SQL text over the ``masks`` array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sqltext import all_of, array, case, plus, text
from tidemark.operators.profile import Layout

EMPTY_ID = "empty"


def set_bits(layout: Layout, v: int, masks: str = "masks") -> str:
    return plus(f"bit_count({masks}[{i}])" for i in layout.words_of(v))


def participates(layout: Layout, v: int, masks: str = "masks") -> str:
    """A variable takes part when some but not all of its values are set."""
    bits = set_bits(layout, v, masks)
    return all_of([f"{bits} > 0", f"{bits} < {layout.variables[v].width}"])


def canonical_masks(layout: Layout, masks: str = "masks") -> str:
    return array(case([(participates(layout, v, masks), f"{masks}[{i}]")], "0L") for i, v in enumerate(layout.word_var))


def n_vars(layout: Layout, masks: str = "masks") -> str:
    return plus(f"int({participates(layout, v, masks)})" for v in range(len(layout.variables)))


def n_elements(layout: Layout, masks: str = "masks") -> str:
    return plus(
        case([(participates(layout, v, masks), set_bits(layout, v, masks))], "0") for v in range(len(layout.variables))
    )


def pattern_key(masks: str = "masks", cls: str = "class") -> str:
    """Readable identity of canonical masks plus class; every empty pattern is the same one."""
    return case(
        [(f"NOT exists({masks}, m -> m <> 0)", text(EMPTY_ID))],
        f"concat_ws(':', {cls}, array_join(transform({masks}, m -> string(m)), '.'))",
    )


def canonicalise(patterns: DataFrame, layout: Layout) -> DataFrame:
    out = patterns.withColumn("masks", F.expr(canonical_masks(layout)))
    return out.withColumn("pattern_id", F.expr(pattern_key()))


def pattern_shape(patterns: DataFrame, layout: Layout) -> DataFrame:
    """Complexity columns: participating variables, set values in them, and whether the pattern is empty."""
    return patterns.withColumns(
        {
            "n_vars": F.expr(n_vars(layout)),
            "n_elements": F.expr(n_elements(layout)),
            "is_empty": F.expr(f"{n_vars(layout)} = 0"),
        }
    )


def non_empty(patterns: DataFrame) -> DataFrame:
    """Patterns (canonical) that say something; the others cover no row."""
    return patterns.filter("exists(masks, m -> m <> 0)")


def rule_text(patterns: DataFrame, layout: Layout) -> DataFrame:
    """Add ``rule``: one readable line per pattern, fuzzy labels with their feet."""
    clauses = []
    for v, variable in enumerate(layout.variables):
        shown = []
        for i in layout.words_of(v):
            for j in range(layout.word_width(i)):
                value = layout.word_low[i] + j
                if variable.nominal:
                    label = variable.domain[value]
                else:
                    label = f"Label {value} (" + ", ".join(f"{x:.6f}" for x in variable.labels[value]) + ")"
                shown.append(case([(f"getbit(masks[{i}], {j}) = 1", text(label))]))
        clause = f"concat({text(variable.name + ' IN {')}, concat_ws('; ', {', '.join(shown)}), '}}')"
        clauses.append(case([(participates(layout, v), clause)]))
    body = f"concat_ws(' AND ', {', '.join(clauses)})"
    rule = case([(f"{n_vars(layout)} = 0", "'Empty rule'")], f"concat('IF ', {body}, ' THEN ', class)")
    return patterns.withColumn("rule", F.expr(rule))
