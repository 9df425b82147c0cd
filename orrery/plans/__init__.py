

from orrery.plans import catalog, client, extraction  # noqa: F401  the last two add to the first one's registry
