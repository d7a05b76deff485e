"""DataFrame-to-DataFrame operators: cohort, vocabulary, sequences, examples, forecasting, risk models,
ranking metrics and vector operations. Each module documents its shuffles and bounds."""
