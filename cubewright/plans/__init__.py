"""From text to plans: syntax trees, values, contexts, the planner."""
