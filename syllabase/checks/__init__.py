from . import reads, texts, programmes, sourcing, matched, upkeep, web, flows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
