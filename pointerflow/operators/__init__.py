"""Jobs from events to statistics; every function takes and returns DataFrames."""
