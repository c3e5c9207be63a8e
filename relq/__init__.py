"""relq: relevance-data preparation and evaluation as Spark DataFrame jobs.

Common entry points (all DataFrame -> DataFrame or Column -> Column):

    from relq import configure, read_corpus, make_samples, gold_rows, s1_accuracy, s2_rates, knn_topk
"""

from relq.operators.evaluation import mean_summary_similarity, s1_accuracy, s2_rates  # noqa: F401
from relq.operators.gold import gold_flag, gold_rows  # noqa: F401
from relq.operators.positions import (grouped_prefix_sum, head_rows, materialize, number_by_key,  # noqa: F401
                                      slice_rows, with_position)
from relq.operators.retrieval import first_queries, knn_topk, mean_precision_at_k, precision_at_k  # noqa: F401
from relq.operators.sampling import make_samples, shuffle_order  # noqa: F401
from relq.session import configure  # noqa: F401
from relq.sources.tables import read_corpus  # noqa: F401
