"""ledgerlint: audit, repair, aggregate and model retail transaction tables on Spark.

Every public function takes and returns a ``DataFrame`` built from built-in
expressions, so Catalyst plans the work and it runs the same on a laptop or a
cluster.
"""

from ledgerlint.schema import (  # noqa: F401
    Columns,
    RuleSet,
    REFERENCE_COLUMNS,
    REFERENCE_RULES,
    REPORT_RULES,
    VIEW_COLUMNS,
    VIEW_RULES,
)
from ledgerlint.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
