"""Query catalogue: name -> (Spark callable, oracle SQL)."""
