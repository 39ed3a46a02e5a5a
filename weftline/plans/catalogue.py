"""Imports every module that registers queries."""

from weftline.plans import q_graph  # noqa: F401
from weftline.plans import q_text  # noqa: F401
from weftline.plans import q_code  # noqa: F401
