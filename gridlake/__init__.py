"""gridlake: building, analysing and evaluating machine-learning datasets on Spark."""
