"""The whole workflows: training set, scoring, evaluation, pairwise ranking."""
