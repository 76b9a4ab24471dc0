"""Market-panel analytics on Spark: long (date x ticker) panels, rule graphs and strategy evidence."""
