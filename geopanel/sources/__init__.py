"""Sources and sinks: dataset registry, CSV with missing-value tokens, panels on the bundled tables, exports."""
