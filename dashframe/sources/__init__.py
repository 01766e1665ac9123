"""Sources and sinks: Parquet/CSV/JSON tables, folders of workbooks, the
upload guard, stored tables, records and result bundles."""
