"""JavaScript syntax and flow analysis in plain Python; captured code is data here and is never run."""
