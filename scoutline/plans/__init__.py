"""Multi-operator plans, and the bindings of every operator to the test tables."""
