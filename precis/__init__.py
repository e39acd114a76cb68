"""precis: summary-utility evaluation as Spark DataFrame jobs.

Text cleaning, sentence splitting, extractive summarisers and the
TF-IDF + logistic-regression evaluation are all expressed as DataFrame
plans (joins, aggregations, windows) so that they scale with the corpus.
"""

from precis.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
