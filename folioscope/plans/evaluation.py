"""Job: evaluate candidates from their locators, gates and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import evaluate

CANDIDATE = ["candidate_id"]


def evaluate_candidates(
    locators: DataFrame, candidates: DataFrame, gate_rules: dict[str, dict], fit_credits: dict[str, int],
    selectivity_credits: dict[str, int], decisions: DataFrame | None = None,
) -> DataFrame:
    """One row per candidate: populations, bounds, machine outcomes, human decision.

    ``candidates(candidate_id, validity)``. Any blocker, inconsistent or not
    measured row makes the assessment insufficient, and so does having no
    measured locator; an uninspectable row leaves a valid candidate
    indeterminate. A gate that may still fire does not fire. All
    numbers of a candidate come from one pass over the locators and one
    aggregation of a few dozen sums.
    """
    rows = evaluate.with_patterns(locators, ["v_judgment", "v_keep", "v_fit", "v_treatment"])
    rows = evaluate.keep_interval(evaluate.classify(rows))
    rows = evaluate.selectivity_interval(evaluate.axis_interval(rows, "fit", fit_credits), selectivity_credits)
    sums = evaluate.grouped(rows, CANDIDATE, {
        **evaluate.population_aggregates(), **evaluate.keep_aggregates(), **evaluate.axis_aggregates(),
        **evaluate.selectivity_aggregates(selectivity_credits), **evaluate.gate_aggregates(gate_rules),
        "n_blockers": F.count_if(F.size(evaluate.unresolved_axes()) > 0),
    })
    gated = F.lit(False)
    for gate, rule in gate_rules.items():
        gated = gated | (F.col(f"{gate}_confirmed") >= rule["at_least"])
    keep, fit = evaluate.keep_results(), evaluate.axis_results()
    measured = sums.select(
        *CANDIDATE, *evaluate.population_aggregates(),
        keep["lower"].alias("precision_lower"), keep["central"].alias("precision"),
        keep["upper"].alias("precision_upper"),
        fit["mean_lower"].alias("fit_lower"), fit["mean_upper"].alias("fit_upper"),
        *[c.alias(name) for name, c in evaluate.selectivity_results(selectivity_credits).items()],
        "n_blockers", gated.alias("gated"),
    )
    board = candidates.join(measured, "candidate_id", "left").withColumns({
        "n_blockers": F.coalesce("n_blockers", F.lit(0)), "gated": F.coalesce("gated", F.lit(False)),
        "sufficient": evaluate.sufficiency(
            F.col("n_blockers"), F.expr("n_locators - not_measured - uninspectable"), F.col("not_measured"), F.col("inconsistent")
        ),
        "validity": evaluate.evidenced_validity(F.col("validity"), F.col("uninspectable")),
    })
    return evaluate.outcomes(board, decisions)
