"""Column functions: text cleaning, names, groups, sentiment and decision lists."""
