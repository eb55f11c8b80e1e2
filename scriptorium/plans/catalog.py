"""The registered queries of the manuscript operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans import panel_queries, part_queries, review_sql, rule_queries, text_queries, tree_queries

MODULES = (rule_queries, text_queries, tree_queries, panel_queries, part_queries)

#: Columns that are 32-bit here and 64-bit in the SQL as it is written.
INTEGERS = {
    "e_04_coverage": ["roles_resolved", "roles_total"], "d_09_lost_text": ["idx"], "h_42_latex_escape": ["idx"], "b_10_parents": ["ord", "parent_ord"], "b_12_flatten": ["idx"],
    "b_13_rebuild": ["idx", "level", "section_ord", "parent_ord"], "b_24_depths": ["sec_ord", "depth"], "b_18_subtrees": ["sec_ord", "last_ord"], "f_03_suggested": ["first", "last"],
    "f_05_ranges": ["idx", "section"], "f_02_equation_numbers": ["ord", "number"], "f_18_breaks": ["idx"], "d_03_captions": ["float_id"], "h_10_equation_tables": ["row"], "l_04_removals": ["idx"],
    "f_08_ranked": ["seq"], "a_01_scanned": ["idx"], "f_09_priorities": ["place"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in (*MODULES, review_sql) for name, sql in module.ORACLES.items()}
    for name, columns in INTEGERS.items():
        casts = ", ".join(f'"{c}"::INTEGER AS "{c}"' for c in columns)
        found[name] = f"SELECT * REPLACE ({casts}) FROM ({found[name]})"
    return found
