"""All queries of the engine by name, and their SQL."""

from lorewell.plans import state, work  # noqa: F401  (they register their queries)
from lorewell.plans.catalogue import QUERIES
from lorewell.plans.oracles import ORACLES as _ORACLES
from lorewell.plans.state_sql import ORACLES as _STATE
from lorewell.plans.work_sql import ORACLES as _WORK

ORACLES = {**_ORACLES, **_WORK, **_STATE}

__all__ = ["ORACLES", "QUERIES"]
