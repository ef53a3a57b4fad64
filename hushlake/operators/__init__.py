"""DataFrame operators: detectors, ensembles, evaluation, dataset work, annotation checks, generation plans."""
