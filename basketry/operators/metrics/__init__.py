from .beyond import diversity_metrics, user_diversity, user_serendipity
from .binary import binary_metrics
from .ranking import evaluate, mean_average_precision, ranking_metrics, user_ranking_metrics
from .rating import rating_metrics
from .roem import roem, roem_detail

__all__ = [
    "binary_metrics",
    "diversity_metrics",
    "evaluate",
    "mean_average_precision",
    "ranking_metrics",
    "rating_metrics",
    "roem",
    "roem_detail",
    "user_diversity",
    "user_ranking_metrics",
    "user_serendipity",
]
