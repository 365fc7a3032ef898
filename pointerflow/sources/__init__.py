"""Sources and sinks, and the mapping of the test tables to the domain."""
