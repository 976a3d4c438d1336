"""Query plans, one module per dataset. Importing this package registers them all."""

from larder.plans import b2b, cleaning, cross, details, dispatch, explore, forecast, inventory, models, pos, production, qc, routes, sensors, streams, waste_returns, exports  # noqa: F401
from larder.plans.registry import ORACLE, QUERIES  # noqa: F401
