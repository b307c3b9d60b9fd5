"""Sources and sinks: typed readers for the raw CSVs, adapters for the driver's
test tables, a stage runner and writers."""

from ebbflow.sources.testdata import TestTables  # noqa: F401
