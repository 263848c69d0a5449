"""Column functions: text cleaning, multi-valued cells, rule classifiers, dated positions."""
