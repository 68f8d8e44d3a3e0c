"""Network-traffic analytics on PySpark: captures, flows, fingerprints, rules, reports and traces."""
