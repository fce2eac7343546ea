"""Training-data operators: fingerprints, duplicate removal, filters, classifiers and tokenisation over whole corpora."""
