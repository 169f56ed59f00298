"""Revenue-cycle analytics for healthcare claims, as Spark DataFrame plans."""

from remitlake.operators.filters import FilterParams
from remitlake.sources.silver import Silver

__all__ = ["FilterParams", "Silver"]
