"""Jobs composed of operators: labels, training matrix, models, assessments."""
