"""Ready-made jobs: the steps of an analysis and the registered queries."""
