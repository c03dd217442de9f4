"""All query modules: importing this fills the registry."""

from voxlake.plans import alignment, audits, budgets, catalogue, evidence, files, folds, predicates, sources, speech, statistics, streams, turns, udfs  # noqa: F401
