"""Plan helpers: staged tables, checked broadcasts, connected components."""
