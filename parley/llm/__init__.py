"""Training-data operators: each module is one operator, `queries` holds the registered queries."""
