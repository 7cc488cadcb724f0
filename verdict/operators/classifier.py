"""Evidence-pair classifier (R10), re-aimed from the neural heads: one
multinomial logistic regression per path over concatenated pooled
claim / evidence vectors, trained and applied with ``pyspark.ml``
(distributed L-BFGS over the partitions)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def train_and_predict(pairs: DataFrame, *, claim_vec: str, evidence_vec: str, label: str,
                      max_iter: int = 50, reg: float = 0.01) -> DataFrame:
    # every pass of the fit, and the prediction, would make the pairs anew
    pairs = cut_lineage(pairs)
    feats = pairs.withColumn("features", array_to_vector(
        F.concat(F.col(claim_vec).cast("array<double>"), F.col(evidence_vec).cast("array<double>"))))
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
                            family="multinomial")
    model = lr.fit(feats)
    out = model.transform(feats)
    return out.withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")
