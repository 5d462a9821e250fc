"""Imports every catalog module so that all queries are registered."""

from . import catalog_evidence  # noqa: F401
from . import catalog_pipeline  # noqa: F401
from . import catalog_relational  # noqa: F401
from . import catalog_retrieval  # noqa: F401
from . import catalog_scalars  # noqa: F401
from . import catalog_text  # noqa: F401
from . import catalog_sources  # noqa: F401
from . import oracles_sources  # noqa: F401  (their SQL)
from . import oracles_decision  # noqa: F401
from . import oracles_text  # noqa: F401
from . import oracles_reports  # noqa: F401
