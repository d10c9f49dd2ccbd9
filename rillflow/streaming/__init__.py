"""Starting, ending and reading back streaming queries."""
