"""All registered queries; importing a module registers its queries."""

from folioscope.plans import q_coverage, q_diff, q_entities, q_evaluate, q_identity, q_measure, q_release  # noqa: F401
from folioscope.plans.registry import ORACLES, QUERIES  # noqa: F401
