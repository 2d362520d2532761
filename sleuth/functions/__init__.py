"""Column helpers (scalar functions, all JVM-side expressions)."""

from sleuth.functions.columns import *  # noqa: F401,F403
from sleuth.functions.schema import *  # noqa: F401,F403
