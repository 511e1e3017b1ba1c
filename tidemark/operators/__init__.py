"""DataFrame operators that the planner and the engine are made of."""
