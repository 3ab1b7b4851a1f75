"""Panel analytics on Spark: events to entity-period panels, features, evaluation and ranked boards."""
