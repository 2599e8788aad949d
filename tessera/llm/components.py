"""Connected components, as the corpus operators use them."""

from ..operators.graph import components, forest  # noqa: F401
