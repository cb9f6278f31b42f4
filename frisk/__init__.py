"""Payment-risk analytics as Spark jobs: features, rules, scores, decisions, reports."""
