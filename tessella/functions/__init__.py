"""Column functions: text rules, cleaning pipelines and the few Arrow functions that Spark has no equal for."""
