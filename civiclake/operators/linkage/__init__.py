"""Probabilistic record linkage (Fellegi and Sunter 1969; EM after Winkler) on DataFrames."""

from civiclake.operators.linkage.compare import Comparison, Linkage, profiles
from civiclake.operators.linkage.pairs import block_pairs, known_spellings, pattern_counts
from civiclake.operators.linkage.model import Model, estimate_m, estimate_u
from civiclake.operators.linkage.predict import cluster_records, clusters, place_records, predict, spanning_clusters, spanning_pairs

__all__ = [
    "Comparison", "Linkage", "Model", "block_pairs", "cluster_records", "clusters", "estimate_m", "estimate_u",
    "known_spellings", "pattern_counts", "place_records", "predict", "profiles", "spanning_clusters", "spanning_pairs",
]
