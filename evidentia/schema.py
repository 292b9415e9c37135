"""Schemas of an evidence base: lists are arrays, flags that may be unknown are nullable booleans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DDL = {
    "papers": "id long, arxiv_id string, title string, authors array<string>, year int, abstract string, theory_tags array<string>, citation_count int, is_review boolean, tier int, source_path string",
    "formulas": "id long, paper_id long, latex string, sympy_expr string, formula_type string, quantity_type string, theory_slug string, description string, variables array<struct<symbol:string,meaning:string,dimensions:string>>, regime string, approximations string, normalized_latex string, normalized_sympy string, confidence double, content_hash string",
    "predictions": "id long, theory_slug string, quantity_type string, formula_id long, paper_id long, symbolic_form string, numerical_value double, numerical_uncertainty double, regime string, notes string",
    "parameters": "id long, theory_slug string, symbol string, meaning string, dimensions string, numerical_value double, role string",
    "claimed_connections": "id long, paper_id long, theory_a string, theory_b string, connection_type string, formula_a_id long, formula_b_id long, description string",
    "conjectures": "id long, conjecture_type string, title string, statement_latex string, statement_natural string, theories_involved array<string>, evidence_formula_ids array<long>, evidence_paper_ids array<long>, algebraic_verified boolean, numerical_verified boolean, dimensional_verified boolean, counterexample_found boolean, is_novel boolean, structural_score double, numerical_score double, combined_score double, status string, notes string",
    "assumptions": "id long, paper_id long, theory_slug string, assumption_text string, assumption_type string, is_stated boolean, category string, how_fundamental string, what_if_wrong string, related_quantity string, confidence double",
    "contradictions": "id long, assumption_a_id long, assumption_b_id long, theory_a string, theory_b string, description string, resolution_candidates array<string>, severity string",
    "obstacles": "id long, theory_slug string, obstacle_type string, description string, paper_ids array<long>, is_universal boolean, what_it_might_mean string",
    "premise_shifts": "id long, problem string, current_premise string, proposed_shift string, shift_type string, evidence_for string, evidence_against string, affected_theories array<string>, historical_analog string, score double",
    "phase_log": "phase string, status string, at timestamp",
    "response_cache": "prompt_hash string, phase string, response_text string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))
