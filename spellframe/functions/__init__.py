"""Column-level building blocks."""
from .periods import *  # noqa: F401,F403
from .predicates import *  # noqa: F401,F403
from .text_rules import *  # noqa: F401,F403
