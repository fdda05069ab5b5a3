"""From text to types (analyser) and to DataFrames (planner)."""
