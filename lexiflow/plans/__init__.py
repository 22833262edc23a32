"""Named queries. The catalog is loaded first, whichever query module is asked for."""

from lexiflow.plans import catalog  # noqa: F401
