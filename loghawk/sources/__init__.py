"""Sources and sinks: provided tables, the API-log view, CSV logs, artefacts."""

from loghawk.sources.tables import TABLES, api_log, read_table  # noqa: F401
from loghawk.sources.logs import read_feedback, read_logs, write_feedback, write_logs, write_report  # noqa: F401
