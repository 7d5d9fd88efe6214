"""Imports every query module, which fills the registry."""

from . import csv_queries, model_queries, telemetry_queries, text_queries, vector_queries  # noqa: F401
from . import file_queries, stream_queries, pipeline_queries  # noqa: F401, I001  their checks reuse SQL that the others register
from .registry import ORACLES, QUERIES  # noqa: F401
