"""tessera: analytics operators expressed as Spark DataFrame plans."""

from tessera.session import get_spark
from tessera.storage import load, materialise

__all__ = ["get_spark", "load", "materialise"]
