from notewise.plans import arrow_jobs, files, metrics, noise, notes, pairs, retrieval  # noqa: F401
from notewise.plans.registry import ORACLES, QUERIES  # noqa: F401
