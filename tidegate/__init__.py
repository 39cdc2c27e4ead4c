"""Network-traffic analytics on Spark: counters, sketches, rules, models and run reports as DataFrame operators."""
