"""Registered queries: importing this module registers every query module.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
"""

from fleetlens.plans.base import ORACLE, QUERIES, canon, r, register  # noqa: F401
from fleetlens.plans import (queries_cluster, queries_core, queries_eval, queries_explain,  # noqa: E402,F401
                             queries_features, queries_ml, queries_models, queries_stream)

queries_core._register_context()
queries_explain._register_r9()
