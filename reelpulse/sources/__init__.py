"""Sources and sinks: test-table readers, canonical readers, the fixture binding, writers."""
