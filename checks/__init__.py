"""Registered queries with their SQL twins, and the tool that compares them."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import queries_history  # noqa: E402,F401
from . import queries_baselines  # noqa: E402,F401
from . import queries_diagnostics, queries_models  # noqa: E402,F401
from . import queries_analogs  # noqa: E402,F401
from . import queries_ensemble  # noqa: E402,F401
from . import queries_learners  # noqa: E402,F401
from . import queries_streams  # noqa: E402,F401
